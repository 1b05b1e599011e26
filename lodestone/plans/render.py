"""Results as text or JSON. Only here are rows collected, at most ``limit`` of each part (one more tells whether there are others)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from .commands import Context, Result

_LABEL = {"High": "High confidence (import-matched)", "Medium": "Medium confidence (wildcard import)", "Low": "Low confidence (no matching import)"}


def _take(rows: DataFrame, n: int) -> tuple[list[dict], int | None]:
    """The first ``n`` rows (0: all), and how many there are in all if more than those."""
    if not n:
        return [r.asDict(True) for r in rows.collect()], None
    got = [r.asDict(True) for r in rows.limit(n + 1).collect()]
    return got[:n], (rows.count() if len(got) > n else None)


def _place(r: dict) -> str:
    return f"{r.get('path') or r.get('file')}:{r['line']}"


def _package(r: dict) -> str:
    return f" ({r['package']})" if r.get("package") else ""


def symbol_json(r: dict) -> dict:
    return {
        "name": r["name"], "kind": r["kind"], "file": r["path"], "line": r["line"], "package": r["package"], "parents": r.get("parents") or [], "typeParamParents": r.get("type_param_parents") or [],
        "signature": r.get("signature") or "", "annotations": r.get("annotations") or [],
    }


def reference_json(r: dict) -> dict:
    out = {"file": r["path"], "line": r["line"], "context": r["context"], "alias": r.get("alias")}
    return out | {k: r[k] for k in ("category", "confidence") if r.get(k)}


def member_json(r: dict) -> dict:
    out = {"name": r["name"], "kind": r["kind"], "line": r["line"], "signature": r["signature"], "file": r["path"], "owner": r["owner"], "ownerKind": r["owner_kind"], "package": r["package"], "inherited": bool(r.get("inherited"))}
    if r.get("is_override"):
        out["isOverride"] = True
    if r.get("body") is not None:
        out |= {"body": r["body"], "bodyStartLine": r["body_start"], "bodyEndLine": r["body_end"]}
    return out


def _symbol_line(r: dict, verbose: bool) -> str:
    sig = f"\n             {r['signature']}" if verbose and r.get("signature") else ""
    return f"  {r['kind']:<9} {r['name']}{_package(r)} — {_place(r)}{sig}"


def _body_lines(r: dict, indent: str) -> list[str]:
    return [f"{indent}{r['body_start'] + i:<4} | {line}" for i, line in enumerate((r.get("body") or "").split("\n"))] if r.get("body") is not None else []


def _more(total: int | None, shown: int, indent: str = "  ") -> list[str]:
    return [f"{indent}... and {total - shown} more"] if total else []


def to_json(result: Result, ctx: Context) -> str:
    """One JSON text for a result; every part is a list, but the shapes that are one list."""
    n = 0 if result.values.get("all") else ctx.flags.limit
    dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"), default=str)
    if result.shape == "usage":
        return dump({"error": result.header})
    rows = {k: _take(v, n)[0] for k, v in result.parts.items()}
    match result.shape:
        case "symbols":
            return dump([symbol_json(r) for r in rows["symbols"]])
        case "strings":
            return dump([r["value"] for r in rows["strings"]])
        case "references":
            found = rows.get("references", [])
            if result.values.get("grouped"):
                by: dict[str, list] = {}
                for r in found:
                    by.setdefault(r["category"], []).append(reference_json(r))
                return dump({"categories": by, "timedOut": False})
            return dump({"results": [reference_json(r) for r in found], "timedOut": False, **({"hint": result.hint} if result.hint else {})})
        case "refs_count" | "counts":
            return dump(rows["counts"])
        case "refs_top":
            return dump([{"file": r["path"], "count": r["count"]} for r in rows["counts"]])
        case "members":
            return dump([member_json(r) for r in rows["members"]])
        case "grep_count":
            return dump({**rows["totals"][0], "timedOut": False})
        case "scopes":
            return dump(rows["scopes"])
        case "hierarchy":
            return dump(tree(result))
        case "coverage":
            t = rows["totals"][0]
            return dump({"symbol": result.values["symbol"], "testFileCount": t["test_file_count"], "referenceCount": t["reference_count"], "references": [reference_json(r) for r in rows["references"]]})
        case "index":
            t, f = rows["totals"][0], rows["files"][0]
            s = result.values.get("stats")
            extra = {"cachedLoad": s.cached_load, "parsedCount": s.parsed_count, "skippedCount": s.skipped_count} if s else {}
            return dump({"fileCount": f["file_count"], "symbolCount": t["symbols"], "packageCount": t["packages"], "symbolsByKind": {r["kind"]: r["count"] for r in rows["kinds"]}, **extra, "parseFailures": f["parse_failures"]})
        case "not_found":
            return dump({"error": result.header, "suggestions": [r["name"] for r in rows.get("suggestions", [])]})
    return dump({**rows, **{k: v for k, v in result.values.items() if k != "stats"}})


def tree(result: Result) -> dict:
    """The recursive form of a flattened hierarchy."""
    root = result.values["root"]
    out = {"node": {"name": root["name"], "kind": root["kind"], "file": root["path"], "line": root["line"], "package": root["package"], "isExternal": False}, "parents": [], "children": []}
    hidden = {tuple(r["path"]): r["hidden"] for r in (result.parts["truncated"].collect() if "truncated" in result.parts else [])}
    for side in ("parents", "children"):
        if side not in result.parts:
            continue
        at: dict[tuple, dict] = {}
        for r in sorted((r.asDict(True) for r in result.parts[side].collect()), key=lambda r: (r["depth"], r["path"])):
            key = tuple(r["path"])
            node = out if r["depth"] == 0 else {"node": {"name": r["name"] or r["node"], "kind": r["kind"], "file": r["file"], "line": r["line"], "package": r["package"] or "", "isExternal": r["is_external"]}, "parents": [], "children": []}
            at[key] = node
            if r["depth"]:
                at[key[:-1]][side].append(node)
            if side == "children" and key in hidden:
                node["truncatedChildren"] = hidden[key]
    return out


def _tree_lines(nodes: list[dict], side: str, indent: str) -> list[str]:
    out = []
    for i, t in enumerate(nodes):
        last, n = i == len(nodes) - 1, t["node"]
        place = " [external]" if n["isExternal"] else f" — {n['file']}:{n['line']}"
        out.append(f"{indent}{'└── ' if last else '├── '}{n['kind'] + ' ' if n['kind'] else ''}{n['name']}{_package(n)}{place}")
        deeper = indent + ("    " if last else "│   ")
        out += _tree_lines(t[side], side, deeper)
        if t.get("truncatedChildren"):
            out.append(f"{deeper}... and {t['truncatedChildren']} more children")
    return out


def to_text(result: Result, ctx: Context) -> str:
    f = ctx.flags
    n = 0 if result.values.get("all") else f.limit
    head = [result.hint] if result.hint else []
    out: list[str] = []
    match result.shape:
        case "usage":
            return result.header
        case "not_found":
            near = _take(result.parts["suggestions"], 5)[0] if "suggestions" in result.parts else []
            return "\n".join([result.header, *(["Did you mean:"] if near else []), *(_symbol_line(r, False) for r in near)])
        case "symbols":
            rows, total = _take(result.parts["symbols"], n)
            if not rows:
                return result.empty or result.header
            out = [_symbol_line(r, f.verbose) for r in rows] + _more(total, len(rows))
        case "strings":
            rows, total = _take(result.parts["strings"], n)
            if not rows:
                return result.empty
            out = [f"  {r['value']}" for r in rows] + _more(total, len(rows))
        case "references":
            rows, total = _take(result.parts["references"], 0 if result.values.get("grouped") else n) if result.parts else ([], None)
            if not rows:
                return "\n".join([*head, result.empty or result.header])
            level = kind = None
            for r in rows:
                if result.values.get("grouped"):
                    if r["confidence"] != level:
                        level, kind = r["confidence"], None
                        out.append(f"\n  {_LABEL[level]}:")
                    if r["category"] != kind:
                        kind = r["category"]
                        out.append(f"\n    {kind}:")
                alias = f" [via alias {r['alias']}]" if r.get("alias") else ""
                out.append(f"{'    ' if result.values.get('grouped') else ''}  {_place(r)} — {r['context']}{alias}")
            out += _more(total, len(rows))
        case "refs_count":
            out = [f"  {r['category']}: {r['count']}" for r in _take(result.parts["counts"], 0)[0]]
        case "refs_top":
            out = [f"  {r['count']:>5} {r['path']}" for r in _take(result.parts["counts"], 0)[0]]
        case "counts":
            out = [f"  {r['kind']:<10} {r['count']}" for r in _take(result.parts["counts"], 0)[0]]
        case "members":
            skip = f.offset
            for part in ("members", "companion"):
                rows, total = _take(result.parts[part].offset(skip) if skip and part == "members" else result.parts[part], n)
                title = None
                for r in rows:
                    where = f"Inherited from {r['owner']}" if r.get("inherited") else f"Companion {r['owner_kind']} {r['owner']}" if part == "companion" else f"Defined in {r['owner']}"
                    if where != title:
                        title = where
                        out.append(f"  {title}:")
                    shown = f"{r['name']:<30}" if f.brief else f"{r['signature']:<50}"
                    out.append(f"    {r['kind']:<5} {shown} :{r['line']}{'  [override]' if r.get('is_override') else ''}")
                    out += _body_lines(r, "      ")
                out += _more(total, len(rows), "    ")
            out = out or ["  (no members)"]
        case "docs":
            for r in _take(result.parts["docs"], n)[0]:
                out += [f"{r['kind']} {r['name']}{_package(r)} — {_place(r)}:", r["doc"] or "  (no scaladoc)", ""]
            return "\n".join(out)
        case "bodies":
            for r in _take(result.parts["bodies"], n)[0]:
                out.append(f"  {r['kind']} {r['owner'] + '.' if r['owner'] else ''}{r['name']} — {r['path']}:{r['start_line']}-{r['end_line']}")
                out += _body_lines({"body": r["text"], "body_start": r["start_line"]}, "  ")
        case "hierarchy":
            t = tree(result)
            out = []
            for side, title in (("parents", "Parents"), ("children", "Children")):
                if side in result.parts:
                    out += [f"  {title}:", *(_tree_lines(t[side], side, "    ") or ["    (none)"])]
        case "overrides":
            rows, total = _take(result.parts["overrides"], n)
            if not rows:
                return result.empty
            for r in rows:
                out += [f"  {r['owner']}{_package(r)} — {_place(r)}", f"    {r['signature']}", *_body_lines(r, "    ")]
            out += _more(total, len(rows))
        case "index":
            t, k = _take(result.parts["totals"], 1)[0][0], _take(result.parts["kinds"], 0)[0]
            files = _take(result.parts["files"], 1)[0][0]
            s = result.values.get("stats")
            first = f"Indexed {files['file_count']} files ({s.skipped_count} cached, {s.parsed_count} parsed)" if s and s.cached_load else f"Indexed {files['file_count']} files, {t['symbols']} symbols"
            out = [first, f"Packages: {t['packages']}", "", "Symbols by kind:", *(f"  {r['kind']:<10} {r['count']}" for r in k)]
            if files["parse_failures"]:
                out += [f"\n{files['parse_failures']} files had parse errors:", *([f"  {r['path']}" for r in _take(result.parts["failed"], 0)[0]] if f.verbose else ["  Run with --verbose to see the list."])]
            return "\n".join(out)
        case _:
            for name, part in result.parts.items():
                rows, total = _take(part, n)
                out += [f"  {name}:", *("    " + ", ".join(f"{k}={v}" for k, v in r.items() if v not in (None, [], "")) for r in rows), *_more(total, len(rows), "    ")]
    return "\n".join([*head, result.header, *out])


def render(result: Result, ctx: Context) -> str:
    """Text or JSON, cut at the last line end within ``--max-output`` characters."""
    text = to_json(result, ctx) if ctx.flags.json else to_text(result, ctx)
    budget = ctx.flags.max_output
    if budget and len(text) > budget:
        cut = text.rfind("\n", 0, budget + 1)
        text = text[: cut if cut > 0 else budget] + "\n... output cut; raise --max-output or narrow the query"
    return text
