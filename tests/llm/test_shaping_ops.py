"""Packing, URL filters, chat formatting and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weirflow.llm import chat, packing, tokens, url_filter
from weirflow.llm.queries import URL_RULES

DOCS = "doc_id long, text string"


def brute_best_fit(sizes, opened):
    rooms, capacities, out, left = [], [], [0] * len(sizes), sum(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= sizes[i]]
        if not fits:
            capacities.append(opened(sizes[i], left))
            rooms.append(capacities[-1])
            fits = [(rooms[-1], len(rooms) - 1)]
        b = min(fits)[1]
        rooms[b] -= sizes[i]
        out[i] = b
        left -= sizes[i]
    return out, capacities


def test_best_fit_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, 64) for _ in range(rng.randint(0, 60))]
        for opened in (lambda size, left: 64, lambda size, left: 16 if size <= 16 else 64):
            assert packing.best_fit(sizes, opened) == brute_best_fit(sizes, opened)


def test_variable_packing_is_the_cheapest_of_its_limits():
    rng = random.Random(2)
    for cost in (packing.sequence_cost, lambda c: c * c, lambda c: c + 50):
        sizes = [rng.choice([3, 7, 12, 30, 64]) for _ in range(80)]
        bins, final = packing.pack_variable(sizes, (8, 16, 32, 64), cost)
        held = [sum(s for s, b in zip(sizes, bins, strict=True) if b == k) for k in range(len(final))]
        assert all(h <= c and (c == 8 or h > c // 2) for h, c in zip(held, final, strict=True))
        for only in (64,):
            fixed, opened = packing.best_fit(sizes, lambda size, left, only=only: only)
            assert sum(map(cost, final)) <= sum(cost(only) for _ in opened)
    assert packing.pack_variable([], (8,), packing.sequence_cost) == ([], [])


def test_variable_packing_is_no_dearer_than_any_fixed_opening():
    rng = random.Random(6)
    cost = packing.sequence_cost
    narrow = [[rng.randint(a + 1, 2 * a) for _ in range(400)] for a in (256, 512, 1024)]
    few_short = [rng.choice([600] * 9 + [80]) for _ in range(400)]
    natural = [min(8192, int(rng.lognormvariate(6, 1))) + 1 for _ in range(400)]
    for sizes in (*narrow, few_short, [min(8192, x) for x in natural], [5], [8192, 1]):
        _, final = packing.pack_variable(sizes, packing.CAPACITIES, cost)
        for floor in packing.CAPACITIES:
            bins, opened = packing.best_fit(sizes, lambda size, left, floor=floor: min(c for c in packing.CAPACITIES if c >= max(size, floor)))
            held = [0] * len(opened)
            for size, b in zip(sizes, bins, strict=True):
                held[b] += size
            assert sum(map(cost, final)) <= sum(cost(min(c for c in packing.CAPACITIES if c >= h)) for h in held)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "über", "naïve", "x" * 40, "日本", "\n", "  ", "<|endoftext|>"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 30, 400, 3000])))) for i in range(60)]
    return rows + [(100, None), (101, ""), (None, "null id"), (400, "again"), (400, "again")]


def test_packed_ids_round_trip(spark, texts, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_DOCS", 20)
    enc = tokens.encoding(open(tokens.VOCABULARY, "rb").read())
    rows = packing.packed_ids(spark.createDataFrame(texts, DOCS).repartition(3), sequence=512).collect()
    assert len({r.bin_id for r in rows}) == len(rows)
    pieces = []
    for r in rows:
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 512 and r.cu_seqlens[0] == 0 and r.resets == r.cu_seqlens[:-1]
        assert (ids[r.cu_seqlens[-1] :] == 50256).all()
        for d, start, a, b in zip(r.doc_ids, r.token_starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert places[a:b].tolist() == list(range(b - a))
            pieces.append((d, start, ids[a:b].tolist()))
    found = []
    for d in {d for d, _, _ in pieces}:
        own = sorted(p[1:] for p in pieces if p[0] == d)
        joined, texts_of = [], []
        for _, ids in own:
            joined += ids
        while joined:
            cut = joined.index(50256)
            texts_of.append(enc.decode(joined[:cut]))
            joined = joined[cut + 1 :]
        found += [(d, t) for t in texts_of]
    assert sorted(found, key=repr) == sorted(((d, t or "") for d, t in texts), key=repr)


def test_variable_packing_covers_every_token_once(spark, texts):
    enc = tokens.encoding(open(tokens.VOCABULARY, "rb").read())
    rows = packing.variable_packing(spark.createDataFrame(texts, DOCS), (64, 256, 1024)).collect()
    length = {}
    for r in rows:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.n_tokens
        assert r.token_start % 1024 == 0 and r.bin_offset + r.n_tokens <= r.bin_size
    expected = {}
    for d, t in texts:
        expected[d] = expected.get(d, 0) + len(enc.encode_ordinary(t or "")) + 1
    assert length == expected
    bins = {}
    for r in rows:
        bins.setdefault((r.bin_id, r.bin_size), []).append((r.bin_offset, r.n_tokens))
    for (_, size), own in bins.items():
        own.sort()
        assert [a for a, _ in own] == list(np.cumsum([0, *[n for _, n in own]])[:-1])
        assert size == min(c for c in (64, 256, 1024) if c >= sum(n for _, n in own))
    assert packing.variable_packing(spark.createDataFrame([], DOCS)).count() == packing.packed_ids(spark.createDataFrame([], DOCS)).count() == 0


def test_long_runs_are_packed_whole(spark):
    rows = [(1, " " * 10_000_000), (2, "\n" * 300_000 + "x"), (3, "a" * 1_000_000), (4, "日" * 50_000)]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n_tokens", "2 as bin_id")
    enc = tokens.encoding(open(tokens.VOCABULARY, "rb").read())
    lengths = {r.doc_id: r.n for r in packing.variable_packing(frame).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    ids = {d: tokens.ids(enc, t) for d, t in rows}
    assert all(enc.decode(ids[d].tolist()) == t and lengths[d] == len(ids[d]) + 1 for d, t in rows)
    held = {}
    for r in packing.packed_ids(frame, sequence=2048).collect():
        for d, start, a, b in zip(r.doc_ids, r.token_starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            held.setdefault(d, {})[start] = np.frombuffer(r.input_ids, "<u2")[a:b]
    assert all(np.concatenate([own[k] for k in sorted(own)])[:-1].tolist() == ids[d].tolist() for d, own in held.items())


# URL filters


def brute_scores(edges, seeds):
    trust = {h: t for h, (t, _) in seeds.items()}
    block = {h: b for h, (_, b) in seeds.items()}
    nt, nb = max(1, sum(trust.values())), max(1, sum(block.values()))
    trust, block = {h: v / nt for h, v in trust.items()}, {h: v / nb for h, v in block.items()}
    t, b = dict(trust), dict(block)
    out = {h: [d for s, d in edges if s == h] for h in seeds}
    into = {h: [s for s, d in edges if d == h] for h in seeds}
    for _ in range(150):
        nt = {h: 0.15 * trust[h] + 0.85 * sum(t[s] / len(out[s]) for s in into[h]) for h in seeds}
        b = {h: 0.15 * block[h] + 0.85 * sum(b[d] / len(into[d]) for d in out[h]) for h in seeds}
        t = nt
    return t, b


def test_propagation_equals_brute_force(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.site.io" for i in range(12)] + ["good.org", "bad.net", "worse.net"]
    pages, edges = [], set()
    for i in range(120):
        src = rng.choice(hosts)
        path = "/fr/x" if src == "good.org" else "/p"
        targets = rng.sample(hosts, rng.randint(0, 3))
        if src == "h0.site.io":
            targets += ["bad.net", "worse.net"]
        pages.append((i, f"http://{src.upper() if i % 2 else src}{path}?q#f", "".join(f'<a href="https://{t}/z">' for t in targets) + '<a href="/own">'))
        edges |= {(src, t) for t in targets if t != src}
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(frame, URL_RULES).collect()}
    known = {u.split("/")[2].lower() for _, u, _ in pages} | {d for _, d in edges}
    seeds = {h: (float(h == "good.org"), float(h.endswith(".net") and h in {u.split("/")[2].lower() for _, u, _ in pages})) for h in known}
    t, b = brute_scores(edges, seeds)
    blocked = {h for h in known if b[h] * len(known) > url_filter.LEAST and b[h] > t[h]}
    assert any(h.startswith("h") for h in blocked) and any(h.startswith("h") and h not in blocked for h in known)
    for i, url, _ in pages:
        host = url.split("/")[2].lower()
        expected = "allow" if host == "good.org" else "block" if host.endswith(".net") or host in blocked else "allow"
        assert got[i].verdict == expected and got[i].host == host


def test_distrust_reaches_hosts_many_links_away_as_in_sql(spark):
    """A chain of thirty hosts that ends at a blocked one: propagation goes on until it is done, and equals the SQL."""
    import duckdb

    from weirflow.llm import queries

    hosts = [f"c{i}.io" for i in range(30)] + ["end.net"]
    pages = [(i, f"http://{h}/p", f'<a href="http://{hosts[i + 1]}/">' if i < 30 else None) for i, h in enumerate(hosts)]
    pages += [(100 + i, f"http://lone{i}.io/", "") for i in range(200)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    expected = {r[0]: r[1:] for r in con.execute(queries.ORACLES["op6_url_filter"]).fetchall()}
    assert got == expected
    # 231 hosts: 0.15 * 0.85 ** d * 231 > 0.5 up to 26 links away.
    assert [got[i][3] for i in range(30)] == ["allow"] * 4 + ["block"] * 26


def test_url_parts_and_rules(spark):
    cases = [
        ("HTTP://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"), ("x://net", "net", "", None, "allow"), ("x://net/", "net", "/", "net/", "block"),
        ("x://sub.net/?q", "sub.net", "/", "net/", "block"), ("x://example.com/de/1#z", "example.com", "/de/1", "example.com/de/", "block"), ("x://example.com/de", "example.com", "/de", None, "allow"),
        ("x://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("x://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"), ("x://É.ORG/fr/", "É.org", "/fr/", "org/fr/", "allow"),
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no-scheme/x", "", "", None, "allow"), ("a://b?c://d/e", "b", "", None, "allow"), ("://h/p\nq", "h", "/p\nq", None, "allow"),
        ("x://h.net:80/en/", "h.net:80", "/en/", None, "allow"),
    ]
    frame = spark.createDataFrame([(i, c[0], None) for i, c in enumerate(cases)], "page_id long, url string, html string")
    rows = url_filter.filter_urls(frame, URL_RULES).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [c[1:] for c in cases]
    assert url_filter.filter_urls(frame.limit(0), URL_RULES).count() == 0


# Chats


def test_chats_round_trip(spark):
    nasty = ["", None, "\\", "<", "\\l<\\s", "</turn>\n<turn>user\nx", "### Assistant: ", "日本\\", "\n\n", "\\\\n", "a" * 50_000, "<image:0>"]
    rows = [(c, i, r, t) for c in range(3) for i, (r, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant", "sys\ntem<", None))]
    rows += [(None, 0, "assistant", "no id"), (9, 1, "assistant", "b"), (9, 0, "assistant", "a"), (9, 1, "assistant", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1))
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(frame.withColumn("content", chat.text_part(F.col("text"))))).collect()}
    assert set(back) == {0, 1, 2, 9, None}
    for c in back:
        own = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, r, x in own]
        assert back[c].loss_text == "".join(x for _, r, x in own if r == "assistant")


def test_typed_parts(spark):
    part = "struct<type:string,text:string,ref:string,units:bigint>"
    content = [("text", "look <", None, None), ("image", None, "a.png", 2), None, ("audio", None, "b.wav", 10), ("text", "?", None, None), ("document", None, None, None), ("odd", None, "c", 1)]
    frame = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", None), (1, 2, "assistant", [])], f"conv_id long, turn long, role string, content array<{part}>")
    row = chat.format_chats(frame).first()
    assert row.formatted == "<turn>user\nlook \\l<image:0><audio:1>?<document:2><document:3></turn>\n<turn>assistant\n</turn>\n<turn>assistant\n</turn>\n"
    assert [tuple(a) for a in row.attachments] == [(0, 0, "image", "a.png", 512), (0, 1, "audio", "b.wav", 250), (0, 2, "document", None, 0), (0, 3, "document", "c", 400)]
    assert row.n_tokens_expanded == 1162 and all(s.start == s.end for s in row.loss_spans)
    assert chat.format_chats(frame.limit(0)).count() == 0


# The pipeline


def test_each_stage_takes_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    long = next(r for r in rows if len(r.text.split()) > 300 and "\n" in r.text)
    copy = long.text.split(" ")
    copy[10] = "changed"
    extra = [(900_001, None, "en", "s", 0), (900_002, "12 34", "en", "s", 5), (900_003, "a lead and\n" + item + "\nand an end", "en", "s", 9), (900_004, " ".join(copy).replace("\n", " "), "en", "s", 9), (900_005, long.text.replace("\n", " "), "en", "s", 9)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held[name] = {r.doc_id: r for r in docs.collect()}
    assert set(held["language_id"]) == {r.doc_id for r in rows} | {900_003, 900_004, 900_005}
    assert all(r.n_chars == len(r.text) or r.text == next((x.text for x in rows if x.doc_id == k), r.text) for k, r in held["line_dedup"].items())
    assert {900_004, 900_005} - set(held["near_dedup"]) and len(held["near_dedup"]) < len(held["line_dedup"])
    assert 900_003 in held["near_dedup"] and 900_003 not in held["decontamination"]
    assert set(held["best_fit_packing"]) == set(held["decontamination"])


def test_texts_in_no_learned_language_are_dropped(spark, sf_dir):
    rng = random.Random(5)
    foreign = [
        "Każdy człowiek ma prawo do życia, wolności i bezpieczeństwa swej osoby, a nikt nie może być trzymany w niewoli lub w poddaństwie.",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(40)),
        "SELECT a.id, b.qty, c.mkt FROM a JOIN b USING (id) JOIN c USING (key) WHERE b.qty > 10 AND c.idx < 7 GROUP BY a.id, b.qty, c.mkt;\n" * 3,
    ]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    planted = spark.createDataFrame([(900_001 + i, t, None, "s", len(t)) for i, t in enumerate(foreign)], docs.schema)
    kept = corpus_pipeline.keep_known_languages(spark, docs.unionByName(planted), sf_dir)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()}


def test_stages_pass_clashing_columns_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("score", "lang_pred", "fluency", "n_lines", "n_removed", "_id", "_own", "_cut", "_done", "_found", "held_id", "dropped_id", "a.b"))])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, sf_dir)
        assert out.columns == more.columns, name
        row = out.first()
        assert all(row[c] == i for i, c in enumerate(more.columns[5:])), name
        assert {r.doc_id for r in out.collect()} == {r.doc_id for r in stage(spark, docs, sf_dir).collect()}, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.pack(spark, more, sf_dir).count() > 0 and corpus_pipeline.pack(spark, docs.limit(0), sf_dir).count() == 0


def test_the_pipeline_runs(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
