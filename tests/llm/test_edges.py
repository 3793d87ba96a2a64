"""Awkward rows: repeated and missing ids, clashing columns, ties, empty tables, broken markup, and work in proportion to the text."""

import os
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.llm import _common as C
from cartolith.llm import ann, byte_bpe, exact_dedup, html_text, lang_id, line_dedup, near_dedup, packing, pii, queries, secret_scan

LONG = "many words of a text that goes on for quite some time so that it has shingles enough to tell one from another in spite of a change"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_smallest_takes_no_more_where_keys_tie(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 10, F.col("id")).otherwise(77).alias("h"), F.lit("x").alias("text"))
    assert len(C.smallest(df, "h", 100)) == 100 and len(C.smallest(df, "h", 5)) == 5 and C.smallest(df.where("false"), "h", 5) == []


def test_exact_dedup_keeps_columns_of_any_name(spark):
    rows = [(1, "a b", "s1", 11), (1, "ab", "s2", 12), (None, "a  b ", "s3", 13), (None, None, "s4", 14), (2, "", "s5", 15), (3, "x", "s6", 16), (3, "x", "s6", 16)]
    df = frame(spark, rows, "doc_id long, text string, digest_of_text string, times long")
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.digest_of_text for r in kept.collect()) == ["s3", "s5", "s6"]
    odd = df.withColumnsRenamed({"digest_of_text": "__sum", "times": "__n"})
    assert sorted(r["__sum"] for r in exact_dedup.drop_duplicates(odd).collect()) == ["s3", "s5", "s6"]
    assert exact_dedup.drop_duplicates(df.where("false")).count() == 0


def test_near_dedup_of_repeated_and_missing_ids(spark):
    near, other = LONG + " word", "this text has nothing to do with any of the others here at all"
    rows = [(5, LONG), (5, other), (7, near), (9, other + " indeed"), (None, LONG + " again"), (None, "alone in its own component it is, this text, and without an id"), (8, None), (8, ""), (None, " ")]
    got = near_dedup.annotate(frame(spark, rows), size=3, percent=80).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter([(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (None, 5, False), (None, None, True), (8, 8, True), (8, 8, True), (None, None, True)])
    more = frame(spark, [(i, t, "id", "hash", 0) for i, t in rows + rows[:1]], "doc_id long, text string, id string, hash string, node long")
    kept = near_dedup.representatives(more, 3, 80)
    assert kept.columns == more.columns
    assert Counter(r.text for r in kept.collect()) == Counter([LONG, other, rows[5][1], None, "", " "])


def test_near_dedup_of_large_buckets(spark, monkeypatch):
    """Every bucket with open pairs takes the set-similarity join; hubs are salted."""
    monkeypatch.setattr(near_dedup, "SMALL", 1)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(3):
        base = rng.choices(words, k=50)
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(50)] = rng.choice(words)
            rows.append(" ".join(copy))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, rows)]
    up = list(range(len(rows)))
    top = lambda i: i if up[i] == i else top(up[i])
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = {r.doc_id: r.component_id for r in near_dedup.annotate(frame(spark, list(enumerate(rows))), size=3, percent=85).collect()}
    assert got == {i: top(i) for i in range(len(rows))}


def test_line_dedup_of_repeated_and_missing_ids(spark):
    rows = [(None, "one two three\nsomething else here", "a", 1), (4, "one two three\n\n \t", "b", 2), (4, "one two three\n\n \t", "c", 3), (2, None, "d", 4), (3, "three two one", "e", 5)]
    df = frame(spark, rows, "doc_id long, text string, removed string, line_no long")
    marks = {(r.doc_id, tuple(r.removed), r.n_links) for r in line_dedup.annotate(df).collect()}
    assert marks == {(3, (), 0), (4, (0,), 0), (None, (0,), 0)}
    clean = line_dedup.deduplicated(df)
    assert clean.columns == df.columns
    assert {(r.doc_id, r.text, r.removed) for r in clean.collect()} == {(None, "something else here", "a"), (4, "\n \t", "b"), (4, "\n \t", "c"), (2, None, "d"), (3, "three two one", "e")}


def test_byte_bpe_of_no_rows_and_missing_ids(spark):
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("byte_bpe_multi_50k.tiktoken"))
    df = frame(spark, [(None, "some text", 1), (1, None, 2), (1, "", 3)], "doc_id long, text string, n_tokens long")
    got = byte_bpe.annotate(df, path, public.PATTERN).collect()
    assert [(r.doc_id, r.n_tokens > 0) for r in got] == [(None, True), (1, False), (1, False)]
    assert byte_bpe.annotate(df.where("false"), path, public.PATTERN).count() == 0


def test_byte_bpe_of_long_texts_and_small_tables(monkeypatch):
    public, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    t = byte_bpe.Tokenizer(str(public.path("byte_bpe_multi_50k.tiktoken")), public.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=t.bpe.ranks, special_tokens={})
    monkeypatch.setattr(byte_bpe, "CHARS", 100)
    monkeypatch.setattr(byte_bpe, "PIECES", 50)
    monkeypatch.setattr(byte_bpe, "STATES", 30)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdeéß 漢字 12.\n") for _ in range(rng.choice([0, 5, 60, 700]))) for _ in range(200)] + ["x" * 3000, "ab" * 900]
    assert [np.frombuffer(x, "<u4").tolist() for x in t.encode_many(texts)] == [known.encode_ordinary(x) for x in texts]


def test_packing_of_repeated_rows_and_sequences(spark):
    items = frame(spark, [(None, 40, "a", None)] * 3000 + [(None, 0, None, None)] * 500 + [(1, 0, "s", "c")], "doc_id long, size long, source string, cluster string")
    rows = packing.pack(items, capacity=100, group=500).collect()
    assert len(rows) == 3501 and sum(r.length for r in rows) == 3000 * 40
    sizes = Counter(r.bin_group for r in rows if r.bin_no is not None)
    assert len(sizes) == 6 and max(sizes.values()) < 1000 and sizes.get(None) is None
    texts = {i: "é" * (i * 7 % 90) + str(i) * (i % 5) for i in range(60)} | {60: "long text " * 40, 61: None, 62: ""}
    docs = frame(spark, [(i, t, "s", "bytes") for i, t in texts.items()], "doc_id long, text string, source string, size string")
    packed = packing.pack(packing.items_of(docs), capacity=128)
    found, parts = packing.sequences(packed, docs).collect(), {}
    for r in found:
        assert len(r.data) <= 128
        for i, a, b in zip(r.doc_ids, r.begins, [*r.begins[1:], len(r.data)]):
            parts.setdefault(i, []).append(bytes(r.data[a:b]))
    whole = lambda i: (texts[i] or "").encode()
    assert {i for i in texts if whole(i)} == set(parts)
    for i, p in parts.items():
        assert sorted(p) == sorted(whole(i)[k : k + 128] for k in range(0, len(whole(i)), 128))
    assert packing.pack(items.where("false")).count() == 0


def in_time(run, *texts):
    """The work on texts of a kind grows with their length, not with its square: within seconds for a long one."""
    began = time.process_time()
    out = [run(x) for x in texts]
    assert time.process_time() - began < 30
    return out


def test_secret_scan_is_linear(spark):
    import pyarrow as pa

    scan = lambda x: secret_scan.scan_column(pa.array([x]))[0]
    n = 30_000
    got = in_time(scan, "eyJ" * n + ".eyJ", "eyJ" * n + ".eyJab.c", "a" * (10 * n), "token=" + " " * n + "x", "token: " * n, "AKIA" * n, "-----BEGIN PRIVATE KEY-----" * (n // 9))
    assert [len(x) for x in got] == [0, 0, 1, 0, 0, 1, n // 9]
    rows = frame(spark, [(1, "token: abcdefgh")] * 3 + [(None, None)])
    assert sorted(len(r.spans) for r in secret_scan.scan(rows).collect()) == [0, 1, 1, 1]


def test_html_of_broken_pages():
    text = html_text.extract
    n = 30_000
    in_time(text, "<a " * n, "<div>" * n + "x", "<ul>" * n, "<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<article>" * n + "x", '<a b="x>' * n, "<!--" * n, "<div>x" * n + "</section>" * n)
    assert text('<article><p>One <a href="x>link</a> of two.</p><p>Then "this" and <a href="y">that</a>.</p></article>') == 'One link of two.\n\nThen "this" and that.'
    assert text("<article><p>a < b, and 3 <4.</p><p title='a > b'>Next.</p></article>") == "a < b, and 3 <4.\n\nNext."
    assert text("<article><p>The end is <a href='cut") == "The end is"


def test_html_keeps_what_articles_hold():
    kept = ["<p class='more'>More of it here.</p>", "<div class='tags'>Tagged so.</div>", "<p class='related share'>Related facts.</p>", "<blockquote class='popular'>Quoted.</blockquote>", "<ul><li>First point</li><li>Second point</li></ul>"]
    gone = ["<div class='ad'>Buy this now, it is cheap.</div>", "<nav><a href=a>Menu</a></nav>", "<div id=comments><p>A reader says so, at length.</p></div>", "<form><label>Mail</label><input></form>", "<div class='cookie-notice'>We use cookies.</div>", "<aside>Beside.</aside>", "<script>var a = 1;</script>", "<style>p {}</style>"]
    rng = random.Random(3)
    strip = lambda x: "\n\n".join(y for y in __import__("re").sub("<[^>]*>", "\n", x).split("\n") if y)
    for _ in range(60):
        inner = rng.sample(kept, 3) + rng.sample(gone, 3)
        rng.shuffle(inner)
        page = f"<html><body><header>Site</header><nav>Menu</nav><article><h1>Title</h1>{''.join(inner)}<p>Last.</p></article><div class='related'><p>Read more of this here.</p></div><footer>Foot</footer></body></html>"
        want = "\n\n".join(["Title", *[strip(x) for x in inner if x in kept], "Last."])
        assert html_text.extract(page) == want


def test_html_of_repeated_rows(spark):
    df = frame(spark, [(1, "u", "<p>One paragraph here, with a sentence.</p>", "n")] * 2 + [(None, None, "", None)], "page_id long, url string, html string, text string")
    got = html_text.text_of(df, html_text.PLAIN).collect()
    assert len(got) == 3 and html_text.text_of(df.where("false"), html_text.PLAIN).count() == 0
    assert html_text.fit(spark.range(3000).select(F.lit(None).cast("string").alias("url"), F.lit("<p>x</p>").alias("html"))) == html_text.PLAIN


def test_pii_of_many_matches_and_repeated_rows(spark):
    many = " ".join(f"x{i}@y.zz" if i % 3 else "no" for i in range(1000)) + " 4111111111111111"
    rows = frame(spark, [(1, many, "n"), (1, many, "n"), (None, None, None), (3, "ssn: 123-45-6789 and 987-65-4321", "x")], "doc_id long, text string, email string")
    got = pii.scan(rows).collect()
    import re

    want = [m.span() for m in re.finditer(r"[a-z0-9]+@y\.zz", many)]
    assert [[(s.start, s.end) for s in r.email] for r in got if r.doc_id == 1] == [want, want]
    assert [[(s.start, s.end) for s in r.ssn] for r in got if r.doc_id == 3] == [[(5, 16)]]
    long = frame(spark, [(1, "a@b.cd " * 20_000)])
    assert len(in_time(lambda df: pii.scan(df).first().email, long)[0]) == 20_000


def test_language_of_letters_and_whole_chains(spark):
    rng = np.random.default_rng(2)
    moves = rng.normal(size=(3, 3))
    m = lang_id.Model(["a", "b", "c"], np.zeros((1 << lang_id.BITS, 3)), moves)
    for n in ([1, 5, 64, 65, 200, 0, 700], [3], [128, 64, 1]):
        unary, at = rng.normal(size=(sum(n), 3)), 0
        got = m._probabilities(unary, np.array(n))
        for c in n:
            if c:
                assert np.allclose(lang_id.forward_backward(unary[None, at : at + c], moves, np.array([c]))[0][0], got[at : at + c])
            at += c
    assert m.label(["½ ②", "①", "x² a_b"])[0][:2] == ["und", "und"] and lang_id.words_of("½x ② A_bé 5c") == ["x", "a", "bé", "c"]
    df = frame(spark, [(None, "the river and the house", "en", "x")] * 3 + [(2, "der fluss und das haus", "de", "y")], "doc_id long, text string, lang string, lang_pred string")
    model = lang_id.fit(df)
    got = lang_id.label(df, model).collect()
    assert [r.lang_pred for r in got] == ["en"] * 3 + ["de"]
    assert [r[0] for r in df.select(lang_id.held_out(F.col("doc_id"))).collect()][:3] == [False] * 3
    assert lang_id.label(df.where("false"), lang_id.fit(df.where("false"))).count() == 0


def test_neighbours_of_missing_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)).tolist()
    rows = [(i, v, "n") for i, v in enumerate(x)] + [(0, x[1], "n"), (0, x[0], "n"), (None, x[2], "n")]
    df = frame(spark, rows, "vec_id long, embedding array<double>, score string")
    got = ann.nearest(df.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0).collect()
    by = Counter(r.query_id for r in got)
    assert by == {0: 5, 50: 5} and all(r.vec_id is not None and r.vec_id != r.query_id for r in got)


def test_queries_against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(4)
    parts = ["token", "secret", "api_key", "=", ":", " ", '"', "abcdef0123", "AKIA", "ABCDEFGHIJKLMNOPQ", "0123456789abcdef", "é", "\n", ".", "-", "1", "44", "@", "+", "4111111111111111", "10.0.0.1", "x@y.zz", "DE89370400440532013000", "ssn 123-45-6789", "eyJ"]
    texts = [None, "", " \n"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    words = "the of river stone mountain token house green seven paper window garden music".split()
    for _ in range(20):
        base = rng.choices(words, k=30)
        texts += [" ".join(base), "\n".join(" ".join(base[i : i + 10]) for i in range(0, 30, 10)), " ".join(base[:-1] + ["changed"])]
    frame(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    vectors = [(i, rng.choices([0.0, 1.0, 2.5, -1.0], k=6)) for i in range(150)]
    frame(spark, vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    for name in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, str(tmp_path))
        want = db.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        columns = ", ".join(sorted(got.columns))
        assert sorted(map(str, db.sql(f"SELECT {columns} FROM want").fetchall())) == sorted(str(tuple(r)) for r in got.select(*sorted(got.columns)).collect()), name


def test_pipeline_of_no_rows_and_more_columns(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, LONG + f" number {i}" * (i % 3) + " token: abcdefghi", "en", None, 9, "id", 1, "x") for i in range(9)]
    df = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long, id string, times long, digest_of_text string")
    for name, table in (("some", df), ("none", df.where("false"))):
        folder = os.path.join(tmp_path, name)
        table.write.parquet(f"{folder}/documents.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == df.columns
        assert pipeline.run(spark, folder).count() == docs.count()
