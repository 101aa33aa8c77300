"""Line dedup, decontamination, near-dedup and fingerprints against brute force and on awkward rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import same_rows

from weirflow.llm import decontaminate, fingerprint, line_dedup, near_dedup, queries
from weirflow.llm import textkernel as tk

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, duck, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), duck.execute(queries.ORACLES[name]))


def words_of(text):
    return (text or "").encode().lower().split()


def shingle_set(text, width):
    w = words_of(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def test_word_hashes_follow_the_words():
    texts = ["A b  c\t\x0bD", None, "", "  ", "x", "A", "é É", "no\xa0break a", "ab c", "a bc", "z" * 5000 + " y"]
    hasher = tk.WordHasher()
    seen = {}
    for _, data, offsets in hasher.chunks(pa.array(texts)):
        hashed, _, _, before = hasher.words(data, offsets)
        for t, text in enumerate(texts):
            own = hashed[before[t] : before[t + 1]].tolist()
            assert len(own) == len(words_of(text))
            for w, h in zip(words_of(text), own, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    for width in (1, 3, 5):
        sets = list(tk.shingle_sets(hasher, pa.array(texts), width))
        assert [len(s) for s in sets] == [len(shingle_set(t, width)) for t in texts]


def test_long_texts_are_hashed_whole():
    rng = random.Random(1)
    long = " ".join(str(rng.getrandbits(20)) for _ in range(300_000))
    hasher = tk.WordHasher()
    assert len(next(iter(tk.shingle_sets(hasher, pa.array([long]), 3)))) == len(shingle_set(long, 3))


# Line dedup


def brute_lines(rows):
    first = {}
    for doc, text in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = text.split("\n")
        for i in range(len(lines) - 2):
            first.setdefault(tuple(lines[i : i + 3]), (doc if doc is not None else 2**63 - 1, i))
    out = []
    for doc, text in rows:
        lines = text.split("\n") if text is not None else []
        cut = set()
        for i in range(len(lines) - 2):
            if (doc if doc is not None else 2**63 - 1, i) > first[tuple(lines[i : i + 3])]:
                cut |= {i, i + 1, i + 2}
        out.append((doc, None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in cut), len(lines), len(cut)))
    return out


def test_line_dedup_on_awkward_rows(spark):
    rng = random.Random(2)
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb\nc"), (4, None), (5, ""), (6, "a\nb"), (7, "q\nq\nq\nq\nq\nq"), (8, "\n\n\n\n"), (9, "a\nb\nc\nd"), (None, "b\nc\nd")]
    rows += [(100 + i, "\n".join(rng.choice("abcde") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(200, "only here 1\nonly here 2\nonly here 3")] * 2
    frame = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "'k' as _at", "doc_id as n_lines", "1 as `odd.name`")
    found = line_dedup.dedup_lines(frame)
    assert found.columns == ["doc_id", "text", "_at", "n_lines", "odd.name", "n_lines_", "n_removed"]
    got = [(r.doc_id, r.text, r.n_lines_, r.n_removed) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_lines(rows)))


def test_line_dedup_of_one_id_with_two_texts_and_clashing_names(spark):
    rows = [(1, "a\nb\nc\nx"), (1, "a\nb\nc\ny"), (2, "a\nb\nc")]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "77 as _id", "78 as _cut", "79 as n_lines", "80 as `a.b`")
    found = line_dedup.dedup_lines(frame)
    assert found.columns == ["doc_id", "text", "_id", "_cut", "n_lines", "a.b", "n_lines_", "n_removed"]
    got = found.collect()
    assert all((r["_id"], r["_cut"], r["n_lines"], r["a.b"]) == (77, 78, 79, 80) for r in got)
    assert sorted(r.n_removed for r in got if r.doc_id == 1) == [0, 3] and [r.text for r in got if r.doc_id == 2] == [""]


# Near-dedup


def brute_components(rows, width, num, den):
    sets = [shingle_set(t, width) for _, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and den * shared >= num * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(rows[i][0]), find(rows[j][0])
                up[max(a, b)] = min(a, b)
    return [(d, len(s), None if d is None else find(d), d is None or find(d) == d) for (d, _), s in zip(rows, sets, strict=True)]


def copies(rng):
    """Families of edited copies, a boilerplate passage in many texts, tiny and empty texts."""
    vocabulary = [f"w{i}" for i in range(3000)]
    boiler = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 5, 45])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(own) + ("" if family % 3 else " " + boiler)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "one two"), (2007, rows[0][1]), (None, rows[0][1]), (2008, rows[5][1]), (2008, rows[5][1])]
    return rows


@pytest.mark.parametrize(("width", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, num):
    rows = copies(random.Random(width))
    frame = spark.createDataFrame(rows, DOCS).selectExpr("text", "doc_id", "1 as root", "2 as component_id")
    got = [tuple(r) for r in near_dedup.near_duplicates(frame, width, num, 100).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(rows, width, num, 100)))


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """Lists and families of many blocks give what one block gives."""
    for name, value in (("BLOCK", 4), ("LIST_BLOCK", 3), ("BLOCK_SHINGLES", 600), ("HUBS", 1)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = copies(random.Random(3))
    got = [tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85, 100).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(rows, 3, 85, 100)))


def test_near_duplicates_of_many_repeated_rows(spark):
    """A row that a table repeats thousands of times, one id with several texts, and near copies of both."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    base, other = [word() for _ in range(90)], [word() for _ in range(50)]
    near = base[:40] + ["changed"] + base[41:]
    rows = [(7, " ".join(base))] * 5000 + [(3, " ".join(near)), (9, " ".join(other)), (7, " ".join(other)), (12, "alone in this")]
    got = {tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5), 3, 85, 100).collect()}
    assert got == set(brute_components(list(dict.fromkeys(rows)), 3, 85, 100))


def test_long_lists_lose_no_link(spark, monkeypatch):
    """Recall where every retained value that pairs share is in lists far longer than a block: texts are mostly one passage of all."""
    for name, value in (("BLOCK", 16), ("LIST_BLOCK", 8), ("HUBS", 2)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(300)]
    rows = []
    for i in range(150):
        tail = [f"t{rng.randrange(10**6)}" for _ in range(rng.choice([5, 20, 40, 120]))]
        rows.append((i * 5 % 151, " ".join(passage[: rng.choice([300, 300, 260])] + tail)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(passage + tail[:-2] + ["x"])))
    got = [tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85, 100).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(rows, 3, 85, 100)))


def test_overlaps_counts_shared_values():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint64) for _ in range(70)]
    expected = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    found = near_dedup.overlaps(sets)
    assert all(expected[i][j] in (None, int(found[i, j])) for i in range(70) for j in range(70))


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id long, text string")
    assert near_dedup.near_duplicates(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.decontaminate(spark.createDataFrame([(1, "a")], DOCS), items).count() == 1
    assert fingerprint.edit_robustness(none).count() == 0


# Decontamination


def test_contamination_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 9, 20, 40, 90])))) for i in range(24)]
    items += [(50, None), (51, " "), (52, items[5][1]), (53, items[5][1].upper())]
    docs = []
    for i in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 30, 800, 6000]))]
        passage = words_of(rng.choice(items[:24])[1])
        passage = [p.decode() for p in passage]
        if i % 3 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = passage
        elif i % 3 == 1 and len(passage) > 30:
            passage[rng.randrange(len(passage))] = "edited"
            body = passage[: len(passage) // 2] + body + passage[len(passage) // 2 - 4 :]
        docs.append((i, " ".join(body)))
    docs += [(90, None), (91, ""), (None, items[6][1]), (92, items[6][1]), (92, items[6][1])]
    frame, table = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.contamination(frame, table).collect()), key=repr)
    expected = []
    for d, text in docs:
        for k, item in items:
            w = words_of(item)
            own = shingle_set(item, min(5, max(1, len(w))))
            held = shingle_set(text, min(5, max(1, len(w)))) if len(words_of(text)) >= min(5, len(w)) else set()
            if own and 100 * len(own & held) >= 80 * len(own):
                expected.append((d, k, len(own & held), len(own)))
    assert got == sorted(expected, key=repr)
    kept = [r.doc_id for r in decontaminate.decontaminate(frame, table).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(d for d, _ in docs if d is not None and d not in {e[0] for e in expected}) and None in kept


def test_scattered_items_are_found(spark):
    """Recall of items of which all, or 0.8, lie in pieces across a document hundreds of times as long."""
    rng = random.Random(13)
    items, docs = [], []
    for i in range(40):
        words = [f"i{i}w{k}" for k in range(rng.choice([30, 60, 200]))]
        items.append((i, " ".join(words)))
        pieces = [words[a : a + 15] for a in range(0, len(words), 15)]
        if i % 2:
            pieces = pieces[: max(1, round(len(pieces) * 0.9))]
        body = [f"n{rng.randrange(10**6)}" for _ in range(20_000)]
        for p, at in zip(pieces, sorted(rng.sample(range(20_000), len(pieces)), reverse=True), strict=True):
            body[at:at] = p
        docs.append((i, " ".join(body)))
    found = decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), num=60)
    expected = {i for (i, d), (_, t) in zip(docs, items, strict=True) if 100 * len(shingle_set(t, 5) & shingle_set(d, 5)) >= 60 * len(shingle_set(t, 5))}
    got = {r.doc_id for r in found.collect()}
    assert len(expected) > 30 and got <= expected and len(got) >= 0.95 * len(expected)


def test_decontaminate_passes_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "q w e r t y u"), (2, "else")], DOCS).selectExpr("*", "5 as held_id", "6 as item_id", "7 as `a.b`")
    items = spark.createDataFrame([(9, "w e r t y")] * 300, "item_id long, text string").selectExpr("*", "1 as key", "2 as minima")
    kept = decontaminate.decontaminate(docs, items).collect()
    assert [(r.doc_id, r.held_id, r.item_id, r["a.b"]) for r in kept] == [(2, 5, 6, 7)]
    assert decontaminate.contamination(docs, items).count() == 300


# Fingerprints


def test_fingerprints_follow_the_contract(spark):
    rng = random.Random(8)
    rows = [(i * 3, " ".join(f"é{rng.getrandbits(9)}" for _ in range(rng.choice([0, 1, 5, 60, 500])))) for i in range(40)]
    rows += [(7, None), (None, "null id"), (200, rows[3][1]), (500, "x" * 40_000)]
    frame = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in fingerprint.edit_robustness(frame).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    prints = {}
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        part = len(text) // 3
        edited = text[: len(text) - part] + after[:part]
        assert got[doc].n_chars == len(text) and got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, got[doc].fingerprint) == got[doc].fingerprint
        assert 0 <= got[doc].near_edited <= 1 and 0 <= got[doc].near_next <= 1
        alone = fingerprint.written(next(iter(fingerprint.Parser().sections(pa.array([text])))))
        assert alone == got[doc].fingerprint and fingerprint.written(fingerprint.read(alone)) == alone
    assert len(set(prints.values())) == len(prints)


def test_fingerprints_tell_edits_from_others(spark, sf_dir):
    rows = fingerprint.edit_robustness(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    long = [r for r in rows if r.n_chars > 300]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97
    assert np.median([r.near_edited for r in long]) > 0.35 and np.median([r.near_next for r in long]) < 0.05


def test_equal_substrings_share_interior_names():
    rng = random.Random(9)
    middle = "".join(chr(97 + rng.randrange(26)) for _ in range(3000))
    parser = fingerprint.Parser()
    level_names = []
    for lead in ("", "q", "some other lead of another length "):
        data = np.frombuffer((lead + middle + lead).encode(), np.uint8)
        level_names.append([set(names.tolist()) for names, _ in parser.levels(data, np.array([0, len(data)]))][:4])
    for other in level_names[1:]:
        for level, (a, b) in enumerate(zip(level_names[0], other, strict=True)):
            assert len(a & b) >= len(a) - 10, level
