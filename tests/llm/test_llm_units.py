"""Parts without Spark: words, tokens, hashes, packing, trees."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm import chat, dart_minhash, license_scan, mph, packing, quality, token_counts, tokens, url_filter, words

TEXT = st.lists(st.sampled_from([*" \n\t\r\x0b\x1c\x85\xa0\u2003\u3000abcéñ×÷ÀßĀ東🙂12.,!?'s#_“–½²", "<|endoftext|>", "'s", "  ", "The", "\n\n"]), max_size=50).map("".join)


@pytest.fixture(scope="module")
def enc():
    return tokens.BatchEncoder(tokens.default_path())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(TEXT, st.none()), min_size=1, max_size=8))
def test_batch_encoder_equals_the_tokenizer(enc, texts):
    ids, at = enc.encode(pa.array(texts, pa.string()))
    for i, e in enumerate(enc.one.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_single_encoder_equals_the_tokenizer(enc, text):
    assert np.frombuffer(enc.one.encode(text), enc.one.dtype).tolist() == enc.one.tokenizer.encode(text, add_special_tokens=False).ids


def test_batch_encoder_shrinks(enc):
    small = tokens.BatchEncoder(tokens.default_path())
    small.SLOTS, small.SHIFT = 1 << 8, words.U(64 - 8)
    small._clear()
    rng = random.Random(1)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6))) for _ in range(50)) for _ in range(3)]
        ids, at = small.encode(pa.array(texts))
        for i, e in enumerate(enc.one.tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert ids[at[i] : at[i + 1]].tolist() == e.ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(TEXT, st.none()), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = words.split(pa.array(texts, pa.string()))
    raw = w.data.tobytes()
    got = [[raw[w.start[j] : w.end[j]].decode() for j in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    flat = [x for t in got for x in t]
    h = w.hashes().tolist()
    assert len({(a, b) for a, b in zip(flat, h, strict=True)}) == len(set(flat)) == len(set(h))


def test_long_words_hash_alike():
    w = words.split(pa.array(["x" * 1000 + " " + "y" * 100, "x" * 1000, "x" * 999]))
    h = w.hashes()
    assert h[0] == h[2] and h[0] != h[3]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
def test_perfect_hash(keys):
    k = np.array(sorted(keys), np.uint64)
    p, size = mph.PerfectHash.from_buffer(mph.PerfectHash.build(k).to_bytes() + b"tail")
    assert sorted(p.number(k).tolist()) == list(range(len(k)))
    assert len(p) == len(k)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 10))
def test_packer_never_overfills(lengths, open_bins):
    p = packing.Packer(64, open_bins)
    bins: dict[int, int] = {}
    for n in lengths:
        b, at = p.place(n)
        assert at == bins.get(b, 0)
        bins[b] = at + n
        assert bins[b] <= 64 and p.open <= open_bins
    assert len(bins) == p.bins


def test_packer_takes_the_fullest_that_fits():
    p = packing.Packer(10, 8)
    p.place(6), p.place(7)
    assert p.place(3) == (1, 7) and p.place(4) == (0, 6)
    with pytest.raises(ValueError):
        p.place(11)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = e[:200], e[50:250]
    doc = np.repeat([0, 1], 200)
    sig = dart_minhash.signatures(doc, np.concatenate([a, b]), np.ones(400), 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - 150 / 250) < 0.05
    wa, wb = np.full(200, 3.0), np.full(200, 1.5)
    sig = dart_minhash.signatures(doc, np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - (150 * 1.5) / (200 * 3 + 50 * 1.5)) < 0.05
    assert (dart_minhash.signatures(np.zeros(1, int), e[:1], np.ones(1), 2, 32)[1] == 0).all()


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "cé", "\n", "\n", "#x", "東", "a b", "\r"]), max_size=40).map(" ".join)), min_size=1, max_size=4))
def test_quality_measures(texts):
    m = quality.measure(pa.record_batch({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())}))
    got = list(zip(*(m[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [brute_quality(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text("<\\|\nan", max_size=12), st.text("<\\|\nax", max_size=14))
def test_chat_turn_round_trip(role, text):
    turn = chat.formatted(role, text)[0]
    assert chat.parsed(turn) == (role, text)
    assert "<|" not in turn[len(chat.START) : -len(chat.END) - 1]


@settings(max_examples=60, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 5), st.text(" \nab.", max_size=6)), max_size=4))
def test_token_tree_follows_edits(enc, text, edits):
    tree = token_counts.TokenTree(text, enc, leaf_bytes=8)
    for at, size, new in edits:
        a = min(at, len(text))
        b = min(len(text), a + size)
        tree.edit((a, b, new))
        text = text[:a] + new + text[b:]
        assert tree.text() == text and tree.n_chars == len(text)
        assert tree.n_tokens == len(enc.one.tokenizer.encode(text, add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(TEXT, st.lists(st.integers(0, 60), max_size=8), st.text(" \nab.\u3000\x1c", max_size=6))
def test_token_tree_follows_many_edits_at_once(enc, text, places, new):
    tree = token_counts.TokenTree(text, enc, leaf_bytes=4)
    cuts = sorted({min(x, len(text)) for x in places})
    edits = [(a, b, new) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
    tree.edit(*edits)
    wanted = token_counts.rewritten(text, edits)
    assert tree.text() == wanted and tree.n_tokens == len(enc.one.tokenizer.encode(wanted, add_special_tokens=False).ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(TEXT, st.none()), min_size=1, max_size=8))
def test_leaves_are_encoded_apart(enc, texts):
    leaves, chars, n = token_counts.cut(pa.array(texts, pa.string()), 4)
    got, tokens, at = leaves.to_pylist(), token_counts.counts(enc, leaves), 0
    assert [len(x) for x in got] == chars.tolist()
    for text, k in zip(texts, n.tolist(), strict=True):
        assert "".join(got[at : at + k]) == (text or "") and k >= 1
        assert tokens[at : at + k].sum() == len(enc.one.tokenizer.encode(text or "", add_special_tokens=False).ids)
        at += k


def test_overlapping_edits_are_an_error(enc):
    with pytest.raises(ValueError):
        token_counts.TokenTree("hello world", enc).edit((0, 5, "a"), (3, 6, "b"))


def test_small_edit_encodes_little(enc):
    text = " ".join(f"word{i}" for i in range(5000))
    tree = token_counts.TokenTree(text, enc)
    assert tree.encoded == len(text)
    tree.edit((20_000, 20_005, "new"))
    assert tree.encoded - len(text) < 2_000


def test_rules_collisions_and_ties():
    rules = [("com/", "allow"), ("a.com/x", "block"), ("b.a.com/", "allow"), ("com/xy", "block")]
    d = url_filter.DigestArray(pa.py_buffer(url_filter.DigestArray.to_bytes(rules)))
    name = lambda j: None if j < 0 else bytes(d.strings[int(d.ends[j]) : int(d.ends[j + 1])]).decode()
    got = [name(j) for j in d.longest(["a.com", "b.a.com", "com", "xcom", "b.a.com", ""], ["/x", "/x", "/", "/", "/q", ""])]
    assert got == ["a.com/x", "b.a.com/", "com/", None, "b.a.com/", None]
    # A key that collides: same digest, other string.
    d.keys = d.keys.copy()
    d.keys[:] = d.keys[0]
    assert d.find([b"nothing"])[0] == -1
    assert len(url_filter.DigestArray.to_bytes([])) > 0


def test_tokenizer_gets_few_pieces_at_once():
    """What the tokenizer gives for a piece is far larger than its ids; those of a whole group of new words must not meet in memory."""
    enc = tokens.BatchEncoder(tokens.default_path())
    whole, given = enc.one.tokenizer, []

    class Counting:
        def encode_batch(self, pieces, **options):
            given.append(len(pieces))
            return whole.encode_batch(pieces, **options)

    enc.one.tokenizer = Counting()
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x" for i in range(j, 17_000, 3)) for j in range(3)]
    got, at = enc.encode(pa.array(texts))
    assert sum(given) > 15_000 and max(given) <= 1 << 12
    for i, text in enumerate(texts):
        assert got[at[i] : at[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids
    enc.encode(pa.array(texts))
    assert sum(given) < 20_000  # all met again
    assert packing.GROUP_BYTES <= 1 << 19


def test_licence_key_words():
    """A text that lacks all key words misses too many bigrams of each short template; long ones hold a gate word themselves."""
    keys = license_scan.key_words(license_scan.TEMPLATES, 0.8)
    for _, text in license_scan.TEMPLATES:
        grams = license_scan.bigrams(text)
        if len(grams) <= license_scan.SHORT:
            assert sum(not license_scan.holds(g, keys) for g in grams) < license_scan.bounds(len(grams), 0.8)[0]
        else:
            assert any(g in text.lower() for g in license_scan.GATES)


def test_licence_key_words_of_all_templates():
    """The same for templates of any size, and for those of numbers and single letters."""
    odd = (("X", "1 2 3 4"), ("Y", "a b c d e f g h i j k l m n o p"))
    for threshold in (0.5, 0.8, 1.0):
        keys = license_scan.key_words((*license_scan.TEMPLATES, *odd), threshold)
        for _, text in (*license_scan.TEMPLATES, *odd):
            grams = license_scan.bigrams(text)
            assert sum(not license_scan.holds(g, keys) for g in grams) < license_scan.bounds(len(grams), threshold)[0]


def test_licence_bounds_are_exact():
    for b in range(1, 500):
        assert license_scan.bounds(b, 0.8) == (-(-2 * b // 3), 3 * b // 2)
