"""A scanner for Scala and Java sources: declarations, members, bodies, scopes, imports, docs, tests.

No compiler takes part. Comments and literals are blanked first, so that what is left can be matched by position; declarations
are found where statements begin; their extents follow from brackets, or from indentation where a block has none. Limits: macros,
unusual layout (several declarations behind one another inside an expression) and XML literals may be missed or cut short. A
source whose brackets don't match counts as not parsed; its tokens and lines are kept.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

TYPES = ("class", "trait", "object", "enum")


def mask(src: str, java: bool = False) -> str:
    """``src`` with comments and literals blanked; line ends and length stay."""
    out = list(src)
    i, n = 0, len(src)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] not in "\r\n":
                out[k] = " "

    while i < n:
        two, c = src[i : i + 2], src[i]
        if two == "//":
            j = src.find("\n", i)
            j = n if j < 0 else j
        elif two == "/*":
            depth, j = 1, i + 2
            while j < n and depth:
                if src.startswith("*/", j):
                    depth, j = depth - 1, j + 2
                elif not java and src.startswith("/*", j):
                    depth, j = depth + 1, j + 2
                else:
                    j += 1
        elif src.startswith('"""', i):
            j = src.find('"""', i + 3)
            j = n if j < 0 else j + 3
            while j < n and src[j] == '"':
                j += 1
        elif c == '"':
            j = i + 1
            while j < n and src[j] not in '"\n':
                j += 2 if src[j] == "\\" else 1
            j += 1
        elif c == "'":
            m = re.compile(r"'(\\u[0-9a-fA-F]{4}|\\.|[^'\\\n])'").match(src, i)
            if not m:
                i += 1
                continue
            j = m.end()
        elif c == "`":
            j = src.find("`", i + 1)
            i = n if j < 0 else j + 1
            continue
        else:
            i += 1
            continue
        blank(i, j)
        i = j
    return "".join(out)


def brackets(text: str) -> dict[int, int] | None:
    """Place of the closing bracket of each opening one; None if they don't match."""
    pairs, stack, close = {}, [], {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", text):
        c = m[0]
        if c in "([{":
            stack.append((c, m.start()))
        elif not stack or stack[-1][0] != close[c]:
            return None
        else:
            pairs[stack.pop()[1]] = m.start()
    return None if stack else pairs


@dataclass
class Decl:
    """A declaration: ``at`` its keyword, ``end`` just past its last character."""

    name: str
    kind: str
    at: int
    head: int
    end: int
    line: int
    end_line: int
    signature: str = ""
    parents: list[str] = field(default_factory=list)
    type_parents: list[str] = field(default_factory=list)
    annotations: list[str] = field(default_factory=list)
    modifiers: tuple[str, ...] = ()
    abstract: bool = False
    params: str = ""
    owner: Decl | None = None

    @property
    def is_type(self) -> bool:
        return self.kind in TYPES


@dataclass
class Source:
    """All facts of one source text."""

    package: str
    decls: list[Decl]
    imports: list[tuple[int, str]]
    failed: bool


_ID = r"(?:[^\W\d]\w*|`[^`\n]+`)"
_OP = r"[!#%&*+\-/:<=>?@\\^|~]+"
_MODS = r"(?:private|protected|final|sealed|abstract|implicit|lazy|override|case|inline|open|transparent|opaque|infix|erased)(?:\[[\w.]+\])?"
_SCALA = re.compile(rf"(?P<annots>(?:@[\w.]+(?:\[[^\]\n]*\])?(?:\([^()]*\))?\s+)*)(?P<mods>(?:{_MODS}\s+)*)\b(?P<kind>package\s+object|class|trait|object|enum|def|val|var|type|given|extension|package|import|case)\b")
_BEGIN = re.compile(r"(?:^|(?<=[{};\n]))[ \t]*", re.M)


class _Lines:
    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]
        self.text = text

    def of(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def span(self, line: int) -> tuple[int, int]:
        end = self.starts[line] - 1 if line < len(self.starts) else len(self.text)
        return self.starts[line - 1], end

    def indent(self, line: int) -> int | None:
        a, b = self.span(line)
        body = self.text[a:b].rstrip()
        return len(body) - len(body.lstrip()) if body.strip() else None


def _balanced(text: str, pairs: dict[int, int], at: int, opening: str) -> int:
    """Past the bracketed groups that begin at ``at`` with one of ``opening``."""
    while True:
        m = re.compile(r"\s*").match(text, at)
        if m.end() < len(text) and text[m.end()] in opening and m.end() in pairs:
            at = pairs[m.end()] + 1
        else:
            return at


def simple_name(type_text: str) -> str:
    """Last part of a type's name, arguments dropped."""
    return re.sub(r"[\[(<{].*$", "", type_text.strip(), flags=re.S).strip().rpartition(".")[2].strip("` ")


def split_top(text: str, seps: str = ",") -> list[str]:
    """Parts between separators outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<" and not (c == "<" and text[i : i + 2] in ("<:", "<%")):
            depth += 1
        elif c in ")]}>" and not (c == ">" and i and text[i - 1] in "=:-"):
            depth -= 1
        elif c in seps and depth <= 0:
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in [*out, text[last:]] if x.strip()]


def leaf_arguments(type_text: str) -> list[str]:
    """Type arguments without arguments of their own, at any depth; ``P[Map[String, User]]`` gives String and User."""
    m = re.match(r"[^\[<]*[\[<](.*)[\]>]", type_text.strip(), re.S)
    if not m:
        return []
    out = []
    for arg in split_top(m[1]):
        inner = leaf_arguments(arg)
        name = simple_name(re.sub(r"^\?\s*(extends|super)\s+|^[+-]", "", arg))
        out += inner if inner else [name] if re.fullmatch(r"[^\W\d]\w*", name) else []
    return out


def _type_parents(parents: list[str], texts: list[str]) -> list[str]:
    low = {p.lower() for p in parents}
    found = [a for t in texts for a in leaf_arguments(t)]
    return list(dict.fromkeys(a for a in found if a.lower() not in low and not re.fullmatch(r"[A-Z]", a)))


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _first_line(masked: str, at: int, lines: _Lines) -> int:
    """The line on which a declaration begins, with its annotations and modifiers."""
    return lines.of(re.compile(r"\s*").match(masked, at).end())


def scala(src: str) -> Source:
    masked = mask(src)
    pairs = brackets(masked)
    if pairs is None:
        return Source("", [], [], True)
    lines = _Lines(masked)
    decls: list[Decl] = []
    imports: list[tuple[int, str]] = []
    package: list[str] = []
    seen = set()
    for b in _BEGIN.finditer(masked):
        m = _SCALA.match(masked, b.end())
        if not m or m.start("kind") in seen:
            continue
        seen.add(m.start("kind"))
        kind, at, rest = re.sub(r"\s+", " ", m["kind"]), m.start("kind"), m.end()
        line = lines.of(at)
        if kind == "import":
            end = _statement_end(masked, rest, lines, pairs)
            for one in split_top(src[rest:end].strip().rstrip(";")):
                imports.append((line, f"import {_clean(one)}"))
            continue
        if kind == "case" and not re.match(rf"\s+{_ID}", masked[rest:]):
            continue
        mods = tuple(re.findall(r"[a-z]+", re.sub(r"\[[^\]]*\]", "", m["mods"])))
        annots = [a.rpartition(".")[2] for a in re.findall(r"@([\w.]+)", m["annots"])]
        if kind == "package" :
            p = re.compile(r"\s*([\w.`]+)").match(masked, rest)
            if p and not package:
                package.append(p[1].replace("`", ""))
            if p:
                decls.append(Decl(p[1], "package", at, p.end(), _extent(masked, p.end(), line, lines, pairs), line, 0))
            continue
        if kind == "package object":
            kind = "object"
        if kind == "case":  # a case of an enum is no symbol of its own
            continue
        found = _scala_decl(src, masked, kind, at, rest, line, lines, pairs, mods, annots)
        for d in found:
            d.line = _first_line(masked, m.start(), lines)
        decls += found
    _nest(decls, lines)
    return Source(package[0] if package else "", decls, imports, False)


def _statement_end(text: str, at: int, lines: _Lines, pairs: dict[int, int]) -> int:
    """End of the line, or of the line on which its last open bracket closes."""
    i = at
    while i < len(text):
        c = text[i]
        if c in ";\n":
            return i
        if c == "}" :
            return i
        i = pairs[i] + 1 if i in pairs else i + 1
    return len(text)


def _extent(text: str, at: int, line: int, lines: _Lines, pairs: dict[int, int]) -> int:
    """Where a declaration ends: at the bracket of its block, or before the first later line that is indented no deeper."""
    base = lines.indent(line) or 0
    i = at
    while True:
        end = _statement_end(text, i, lines, pairs)
        nxt = lines.of(end) + 1
        while nxt <= len(lines.starts) and lines.indent(nxt) is None:
            nxt += 1
        if end < len(text) and text[end] != "\n" or nxt > len(lines.starts):
            return end
        a, b = lines.span(nxt)
        body = text[a:b].strip()
        # A block in braces on the next line, else, catch and so on, or deeper lines: it goes on.
        if lines.indent(nxt) > base or re.match(r"[)\]]|(else|catch|finally|yield|then|do|with|extends|derives)\b|end\s+\S+$|\{|=", body) and not body.startswith("}"):
            i = a
            continue
        return end


def _scala_decl(src, masked, kind, at, rest, line, lines, pairs, mods, annots) -> list[Decl]:
    if kind == "extension":
        end = _extent(masked, rest, line, lines, pairs)
        head = _balanced(masked, pairs, rest, "[(")
        return [Decl("<extension>", kind, at, head, end, line, 0, _clean(src[at:head]), annotations=annots, modifiers=mods)]
    if kind in ("val", "var"):
        stop = re.compile(r"[:=\n]").search(masked, rest)
        pattern = masked[rest : stop.start() if stop else len(masked)]
        if re.match(rf"\s*{_ID}\s*(,\s*{_ID}\s*)*$", pattern):
            names = re.findall(_ID, pattern)
        else:
            names = [n for n in re.findall(rf"(?<![\w.]){_ID}(?![\w.\[(])", pattern) if n[0].islower() or n[0] == "_" and n != "_"]
        if "(" in pattern and stop and masked[stop.start()] == ":":
            close = _balanced(masked, pairs, rest + len(pattern) - len(pattern.lstrip()), "(")
            stop = re.compile(r"[=\n]").search(masked, close)
        end = _extent(masked, rest, line, lines, pairs)
        eq = _equals(masked, rest, end, pairs)
        colon = re.compile(r"\s*:").match(masked, rest + len(pattern))
        type_text = _clean(src[colon.end() : eq if eq is not None else end]) if colon else "?"
        return [Decl(n.strip("`"), kind, at, rest, end, line, 0, f"{kind} {n.strip('`')}: {type_text}", annotations=annots, modifiers=mods, abstract=eq is None) for n in names]
    name_m = re.compile(rf"\s*({_ID}|{_OP})").match(masked, rest)
    if kind == "given":
        named = re.compile(rf"\s*({_ID})\s*(?=[\[(:])").match(masked, rest)
        end = _extent(masked, rest, line, lines, pairs)
        if not named:
            return []
        after = _balanced(masked, pairs, named.end(), "[(")
        head = re.compile(r"\s*:\s*([^={\n]*)").match(masked, after)
        type_text = re.sub(r"\s+with$", "", _clean(head[1])) if head else ""
        parents = [] if _equals(masked, after, end, pairs) is not None else [simple_name(x) for x in re.split(r"\bwith\b|,", type_text) if x.strip()]
        return [Decl(named[1], kind, at, after, end, line, 0, f"given {named[1]}: {type_text}".rstrip(": "), parents, annotations=annots, modifiers=mods)]
    if not name_m:
        return []
    name = name_m[1].strip("`")
    if kind == "def":
        name = name if re.match(_ID, name) else name.rstrip(":") or name
        after_t = _balanced(masked, pairs, name_m.start(1) + len(name_m[1]), "[")
        tparams = src[name_m.start(1) + len(name_m[1]) : after_t]
        after = _balanced(masked, pairs, after_t, "(")
        params = src[after_t:after]
        end = _extent(masked, name_m.end(), line, lines, pairs)
        eq = _equals(masked, after, end, pairs)
        colon = re.compile(r"\s*:\s*").match(masked, after)
        block = masked.find("{", after, end)
        stop = eq if eq is not None else block if block >= 0 and not colon else end
        returned = _clean(src[colon.end() : stop]) if colon else "?"
        proc = eq is None and block >= 0 and not colon
        shown = re.sub(r"\s*=\s*[^,()]+(?=[,)])", "", _clean(params))
        return [Decl(name, kind, at, after, end, line, 0, f"def {name}{_clean(tparams)}{shown}: {returned}", annotations=annots, modifiers=mods, abstract=eq is None and not proc, params=params)]
    if kind == "type":
        end = _extent(masked, name_m.end(), line, lines, pairs)
        eq = _equals(masked, name_m.end(), end, pairs)
        body = _clean(src[eq + 1 : end]) if eq is not None else ""
        return [Decl(name, kind, at, name_m.end(), end, line, 0, f"type {name} = {body[:60]}" if body else f"type {name}", annotations=annots, modifiers=mods, abstract=eq is None)]
    # class, trait, object, enum
    after_t = _balanced(masked, pairs, name_m.end(), "[")
    tparams = src[name_m.end() : after_t]
    ctor = re.compile(rf"(\s*@[\w.]+)*(\s*(private|protected)(\[[\w.]+\])?)?\s*").match(masked, after_t)
    after = _balanced(masked, pairs, ctor.end(), "(")
    params = src[ctor.end() : after]
    end = _extent(masked, name_m.end(), line, lines, pairs)
    ext = re.compile(r"\s*extends\b").match(masked, after)
    parents, texts, head = [], [], after
    if ext:
        i = ext.end()
        while i < end and masked[i] not in "{;" and not (masked[i] == ":" and re.match(r":[ \t]*(\n|$)", masked[i : i + 200])):
            if re.compile(r"derives\b").match(masked, i) and not masked[i - 1].isalnum():
                break
            if masked[i] == "\n":
                nxt = re.compile(r"\s*(with|extends)\b|\s*,").match(masked, i)
                before = masked[ext.end() : i].rstrip()
                if not nxt and not before.endswith((",", "with", "extends")) and before:
                    break
            i = pairs[i] + 1 if i in pairs and masked[i] in "([" else i + 1
        head = i
        clause = masked[ext.end() : i]
        for part in [y for x in re.split(r"\bwith\b", clause) for y in split_top(x)]:
            bare = re.sub(r"\([\s\S]*$", "", part).strip()
            if bare and re.match(r"[\w.`]+", bare):
                parents.append(simple_name(bare))
                texts.append(bare)
    shown = f"{kind} {name}{_clean(tparams)}" + (f" extends {' with '.join(parents)}" if parents else "")
    return [Decl(name, kind, at, head, end, line, 0, shown, parents, _type_parents(parents, texts), annots, mods, params=params)]


def _equals(text: str, at: int, end: int, pairs: dict[int, int]) -> int | None:
    """The ``=`` of a definition, outside brackets."""
    i = at
    while i < end:
        if text[i] == "=" and text[i + 1 : i + 2] not in ("=", ">") and text[i - 1] not in "<>!=:":
            return i
        if text[i] == "{":
            return None
        i = pairs[i] + 1 if i in pairs else i + 1
    return None


def _nest(decls: list[Decl], lines: _Lines) -> None:
    decls.sort(key=lambda d: (d.at, -d.end))
    stack: list[Decl] = []
    for d in decls:
        d.end_line = lines.of(max(d.at, d.end - 1))
        while stack and not (stack[-1].at <= d.at and d.end <= stack[-1].end and stack[-1].at != d.at):
            stack.pop()
        d.owner = stack[-1] if stack else None
        if not (stack and stack[-1].at == d.at):
            stack.append(d)


# --- Java --------------------------------------------------------------------------------------------

_JTYPE = re.compile(r"(?P<annots>(?:@[\w.]+(?:\([^()]*\))?\s+)*)(?P<mods>(?:(?:public|protected|private|abstract|static|final|sealed|non-sealed|strictfp)\s+)*)(?P<kind>class|interface|enum|record|@interface)\s+(?P<name>\w+)")
_JMEMBER = re.compile(
    r"(?P<annots>(?:@[\w.]+(?:\([^()]*\))?\s+)*)(?P<mods>(?:(?:public|protected|private|abstract|static|final|synchronized|native|default|transient|volatile|strictfp)\s+)*)"
    r"(?P<targs><[^(){};=]*>\s+)?(?P<type>[\w.]+(?:\s*<[^(){};=]*>)?(?:\s*\[\s*\])*)\s+(?P<name>\w+)\s*(?P<tail>[(;=,\[])"
)
_JCTOR = re.compile(r"(?P<annots>(?:@[\w.]+(?:\([^()]*\))?\s+)*)(?P<mods>(?:(?:public|protected|private)\s+)*)(?P<name>\w+)\s*(?P<tail>\()")
_JWORDS = {"return", "new", "throw", "else", "package", "import", "assert", "case", "instanceof", "goto", "yield"}


def java(src: str) -> Source:
    masked = mask(src, java=True)
    pairs = brackets(masked)
    if pairs is None:
        return Source("", [], [], True)
    lines = _Lines(masked)
    package = re.search(r"^\s*package\s+([\w.]+)\s*;", masked, re.M)
    imports = [(lines.of(m.start(1)), f"import {re.sub(r'^static\s+', '', _clean(m[2]))}") for m in re.finditer(r"^\s*(import)\s+([^;]+);", masked, re.M)]
    decls: list[Decl] = []

    def block(a: int, b: int, owner: Decl | None) -> None:
        i = a
        while i < b:
            m = re.compile(r"\s*").match(masked, i)
            i = m.end()
            if i >= b:
                return
            if t := _JTYPE.match(masked, i):
                i = type_decl(t, b)
                continue
            if owner and (d := member(i, b, owner)):
                decls.append(d)
                i = d.end
                continue
            while i < b and masked[i] not in ";{}":
                i = pairs[i] + 1 if i in pairs else i + 1
            i = pairs[i] + 1 if i in pairs else i + 1

    def type_decl(t: re.Match, limit: int) -> int:
        kind = {"class": "class", "interface": "trait", "@interface": "trait", "record": "class", "enum": "enum"}[t["kind"]]
        open_ = t.end()
        while open_ < limit and masked[open_] not in "{;":
            open_ = pairs[open_] + 1 if open_ in pairs else open_ + 1
        head = masked[t.end() : open_]
        up = [x for w in ("extends", "implements") for m in re.finditer(rf"\b{w}\b(.*?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)", re.sub(r"^\s*<[^{{}}]*?>(?=\s*(extends|implements|$|\())", "", head), re.S) if m.re.pattern.startswith(rf"\b{w}") for x in split_top(m[1])]
        parents = [simple_name(x) for x in up]
        end = pairs[open_] + 1 if open_ in pairs else open_ + 1
        tparams = re.match(r"\s*(<.*?>)(?=\s*(extends|implements|\(|$))", head, re.S)
        word = {"trait": "interface"}.get(kind, t["kind"])
        sig = f"{word} {t['name']}{_clean(tparams[1]) if tparams else ''}" + (f" extends {', '.join(parents)}" if parents else "")
        d = Decl(t["name"], kind, t.start("kind"), open_, end, _first_line(masked, t.start(), lines), 0, sig, parents, _type_parents(parents, up), [a.rpartition(".")[2] for a in re.findall(r"@([\w.]+)", t["annots"])], tuple(t["mods"].split()))
        decls.append(d)
        if open_ in pairs:
            inner = open_ + 1
            if kind == "enum":
                stop = inner
                while stop < end - 1 and masked[stop] != ";":
                    stop = pairs[stop] + 1 if stop in pairs else stop + 1
                for c in re.finditer(r"(?:^|,)\s*(?:@[\w.]+(?:\([^()]*\))?\s*)*(\w+)", _flat(masked, inner, stop, pairs)):
                    at = inner + c.start(1)
                    decls.append(Decl(c[1], "val", at, at, at + len(c[1]), lines.of(at), 0, c[1], modifiers=("constant",)))
                inner = stop
            block(inner, end - 1, d)
        return end

    def member(i: int, b: int, owner: Decl) -> Decl | None:
        m = _JMEMBER.match(masked, i)
        ctor = None
        if not m or m["type"] in _JWORDS or (m["name"] == owner.name and m["type"] in ("public", "protected", "private")):
            ctor = m = _JCTOR.match(masked, i)
            if not m or m["name"] != owner.name:
                return None
        annots = [a.rpartition(".")[2] for a in re.findall(r"@([\w.]+)", m["annots"])]
        mods, at, line = tuple(m["mods"].split()), m.start("name"), _first_line(masked, m.start(), lines)
        if m["tail"] == "(":
            close = pairs[m.end() - 1]
            stop = close + 1
            while stop < b and masked[stop] not in "{;":
                stop += 1
            end = pairs[stop] + 1 if stop in pairs else stop + 1
            params = _clean(src[m.end() - 1 : close + 1])
            if ctor:
                return Decl("<init>", "def", at, stop, end, line, 0, f"{owner.name}{params}", annotations=annots, modifiers=mods)
            return Decl(m["name"], "def", at, stop, end, line, 0, f"def {m['name']}{params}: {_clean(m['type'])}", annotations=annots, modifiers=(*mods, *(["override"] if "Override" in annots else [])), abstract=stop not in pairs)
        stop = m.end() - 1
        while stop < b and masked[stop] != ";":
            stop = pairs[stop] + 1 if stop in pairs else stop + 1
        kind = "val" if "final" in mods or owner.kind == "trait" else "var"
        return Decl(m["name"], kind, at, stop, stop + 1, line, 0, f"{kind} {m['name']}: {_clean(m['type'])}", annotations=annots, modifiers=mods)

    block(0, len(masked), None)
    _nest(decls, lines)
    return Source(package[1] if package else "", decls, imports, False)


def _flat(text: str, a: int, b: int, pairs: dict[int, int]) -> str:
    """``text[a:b]`` with all that stands in brackets blanked."""
    out, i = [], a
    while i < b:
        j = pairs[i] + 1 if i in pairs else i + 1
        out.append(" " * (j - i) if i in pairs else text[i])
        i = j
    return "".join(out)


def scan(src: str, language: str) -> Source:
    return java(src) if language == "java" else scala(src)


# --- facts ----------------------------------------------------------------------------------------------


def _in_value(d: Decl) -> bool:
    """Whether a declaration stands inside the body of a def, val, var or given."""
    o = d.owner
    while o:
        if o.kind in ("def", "val", "var", "given"):
            return True
        o = o.owner
    return False


def _owner_type(d: Decl) -> Decl | None:
    o = d.owner
    while o and not o.is_type:
        o = o.owner
    return o


def symbols(s: Source, language: str) -> list[dict]:
    out = []
    for d in s.decls:
        if d.kind == "package" or d.name == "<init>" or "constant" in d.modifiers or _in_value(d):
            continue
        if language == "scala" and (d.kind == "var" or d.abstract):
            continue
        out.append({"name": d.name, "kind": d.kind, "line": d.line, "parents": d.parents, "type_param_parents": d.type_parents, "signature": d.signature, "annotations": d.annotations})
    return out


def members(s: Source, language: str) -> list[dict]:
    """Direct members of types, in the order of their declaration."""
    out = []
    for t in s.decls:
        if not t.is_type:
            continue
        rows = []
        if language == "scala" and t.kind in ("class", "enum") and t.params:
            for i, group in enumerate(re.findall(r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)", t.params)):
                for p in split_top(group):
                    m = re.match(r"(?:@\w+(?:\([^)]*\))?\s*)*((?:(?:private|protected|override|final|implicit|inline)(?:\[\w+\])?\s+)*)(val\s+|var\s+)?(?:using\s+)?([\w`]+)\s*:\s*([^=]+)", p)
                    if m and (m[2] or ("case" in t.modifiers and i == 0)):
                        kind = (m[2] or "val").strip()
                        rows.append({"name": m[3].strip("`"), "kind": kind, "line": t.line, "end_line": t.line, "signature": f"{kind} {m[3]}: {_clean(m[4])}", "annotations": [], "is_override": "override" in m[1]})
        for d in s.decls:
            if d.owner is t and d.kind != "package":
                rows.append({"name": d.name, "kind": d.kind, "line": d.line, "end_line": d.end_line, "signature": d.signature, "annotations": d.annotations, "is_override": "override" in d.modifiers})
        out += [{"owner": t.name, "owner_kind": t.kind, "owner_line": t.line, "ord": i, **r} for i, r in enumerate(rows)]
    return out


def bodies(s: Source, src: str) -> list[dict]:
    """Whole source lines of each declaration, local ones too."""
    text = src.split("\n")
    out = []
    for d in s.decls:
        if d.kind in ("package", "extension", "given") or d.name == "<init>" or "constant" in d.modifiers:
            continue
        o = _owner_type(d)
        out.append({"owner": o.name if o else "", "name": d.name, "kind": d.kind, "start_line": d.line, "end_line": d.end_line, "is_abstract": d.abstract, "text": "\n".join(text[d.line - 1 : d.end_line])})
    return out


def scopes(s: Source, n_lines: int) -> list[dict]:
    out = []
    for d in s.decls:
        if d.kind in ("package", "class", "trait", "object", "enum", "def", "val", "extension"):
            depth, o = 0, d.owner
            while o:
                depth, o = depth + 1, o.owner
            last = n_lines if d.kind == "package" and d.end_line <= d.line else d.end_line
            out.append({"name": d.name, "kind": d.kind, "start_line": d.line, "end_line": last, "depth": depth})
    return out


def docs(s: Source, src: str) -> list[dict]:
    """The ``/** … */`` comment right above a declaration; blank lines between are allowed."""
    text = src.split("\n")
    out = []
    for line in sorted({d.line for d in s.decls if d.kind != "package"}):
        i = line - 2
        while i >= 0 and (not text[i].strip() or text[i].strip().startswith("@")):
            i -= 1
        if i < 0 or not text[i].rstrip().endswith("*/"):
            continue
        end = i
        while i >= 0 and "/*" not in text[i]:
            i -= 1
        if i >= 0 and text[i].lstrip().startswith("/**"):
            out.append({"line": line, "doc": "\n".join(text[i : end + 1])})
    return out


_TEST = re.compile(r"\b(?P<call>test|it|describe)\s*\(\s*(?P<arg>\"\"\"|[s]?\"(?P<lit>(?:[^\"\\\n]|\\.)*)\"|[^\s)])|(?P<infix>(?<![\w])\"(?P<lit2>(?:[^\"\\\n]|\\.)*)\"\s+(?:should\s+)?(?:in|>>)\s*[{:\n])|(?P<dyn>\b\w+\s+(?:in|>>)\s+\{)")


def tests(s: Source, src: str) -> list[dict]:
    """Test cases with literal names, and places where the name is computed; both by the innermost type around them."""
    masked = mask(src)
    lines = _Lines(src)
    types = [d for d in s.decls if d.kind in ("class", "object")]
    out = []
    for m in _TEST.finditer(src):
        # Inside comments all is blank; the call's name, or the blank after an infix literal, must not be.
        at = m.start("call") if m["call"] else m.end() - 1
        if masked[at].isspace() and not m["infix"] or re.match(r"\s*def\b", masked[max(0, m.start() - 4) : m.start()]):
            continue
        around = [d for d in types if d.at <= m.start() < d.end]
        if not around:
            continue
        suite = max(around, key=lambda d: d.at)
        name = m["lit"] if m["lit"] is not None and not m["arg"].startswith("s") else m["lit2"]
        if m["call"] == "describe" and name is not None:
            continue
        out.append({"suite": suite.name, "suite_line": suite.line, "test_name": name, "line": lines.of(m.start()), "is_dynamic": name is None})
    return out
