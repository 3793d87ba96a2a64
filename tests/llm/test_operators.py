"""The corpus operators against plain versions of themselves, on small tables with awkward rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.llm import ann, byte_bpe, exact_dedup, html_text, lang_id, line_dedup, near_dedup, packing, pii, secret_scan
from cartolith.llm.automaton import Automaton
from cartolith.llm.components import components
from cartolith.llm.mph import MinimalPerfectHash

WORDS = "the of river stone mountain token house green seven paper window garden music winter salt bridge".split()


def corpus(seed=5):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))
    rows = [None, None, "", " \t\n", "one", "two words", "x" * 3000, text(4000), text(1)]
    for _ in range(12):
        base = text(rng.randint(30, 120)).split(" ")
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = text(1)
            rows.append(rng.choice([" ", "  ", "\n"]).join(copy))
    rows += ["\n".join(text(12) for _ in range(5)) for _ in range(5)]
    rows += rows[-3:] + ["THE Same " + rows[8]] * 4
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src%d" % (i % 3 and 1), "kept", i * 2) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, digest string, keep_id long").repartition(3)


def empty(docs):
    return docs.where("false")


def test_exact_dedup(spark, docs):
    rows = corpus()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    got = {r.doc_id: r for r in exact_dedup.annotate(docs, per_shard=7).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        key = re.sub("[\x20\x09-\x0d]", "", t or "")
        best = min(groups[key])[1]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best, len(groups[key]), best == i, hashlib.sha256(key.encode()).hexdigest())
    assert {r.known for r in got.values()} == {True, False}
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(v)[1] for v in groups.values())
    assert exact_dedup.annotate(empty(docs)).count() == 0
    twice = docs.union(docs)
    assert exact_dedup.drop_duplicates(twice).count() == len(groups)


def test_minimal_perfect_hash():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    mph = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(keys[:4000]).to_bytes())
    slots = mph.slots(keys[:4000])
    assert sorted(slots.tolist()) == list(range(4000))
    assert MinimalPerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3
    assert ((mph.slots(keys[4000:]) >= -1) & (mph.slots(keys[4000:]) < 4000)).all()


def shingle_set(text, size):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_dedup(docs, size, percent):
    sets = {i: shingle_set(t, size) for i, t in corpus()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = {r.doc_id: r for r in near_dedup.annotate(docs, size=size, percent=percent).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}
    kept = near_dedup.representatives(docs, size, percent)
    assert kept.columns == docs.columns and kept.count() == sum(top(i) == i for i in sets)
    assert near_dedup.annotate(empty(docs)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    links = [(a, b) for a, b in links if a != b]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: top(i) for i in list(up)}


def bpe_by_definition(ranks, data):
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_byte_bpe(spark, docs, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = str(public.path("byte_bpe_multi_50k.tiktoken"))
    t = byte_bpe.Tokenizer(path, public.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=t.bpe.ranks, special_tokens={})
    rng = random.Random(1)
    letters = "abcdefgh  éüñ漢字\U0001f600\n\t's.,!?01AZ<|endoftext|>"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        assert t.encode(text) == known.encode_ordinary(text)
        ids, d = t.encode(text), byte_bpe.StreamDecoder(t.bpe.token)
        assert "".join(d.feed([i]) for i in ids) + d.finish() == text
    got = {r.doc_id: r for r in byte_bpe.annotate(docs, path, public.PATTERN).collect()}
    for i, text in corpus():
        ids = known.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(docs, path, public.PATTERN), path, public.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == {i: x or "" for i, x in corpus()}


def test_transducer_with_small_tables(monkeypatch):
    rng = random.Random(8)
    ranks = {bytes([i]): i for i in range(256)}
    while len(ranks) < 320:  # merges made up of tokens there are
        a, b = rng.choice([k for k in ranks if k[0] in b"abc" and k[-1] in b"abc"]), rng.choice([b"a", b"b", b"c", b"ab", b"ca"])
        if b in ranks and len(a + b) < 9:
            ranks.setdefault(a + b, len(ranks))
    monkeypatch.setattr(byte_bpe, "STATES", 20)
    monkeypatch.setattr(byte_bpe, "PAIRS", 20)
    bpe = byte_bpe.ByteBpe(ranks)
    for _ in range(2000):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25)))
        want = [ranks[data]] if data in ranks else bpe_by_definition(ranks, data)
        assert np.frombuffer(bpe.piece(data), "<u4").tolist() == want


def test_utf8_stream():
    token = [bytes([i]) for i in range(256)]
    rng = random.Random(4)
    for _ in range(3000):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC3, 0xA9, 0xE0, 0xA0, 0xED, 0xF0, 0x9F, 0xF4, 0xFF]) for _ in range(rng.randint(0, 9)))
        d = byte_bpe.StreamDecoder(token)
        assert "".join(d.feed([b]) for b in data) + d.finish() == data.decode("utf-8", "replace")


def test_packing(spark, docs):
    rng = random.Random(2)
    items = [(i, rng.choice([0, 5, 40, 99, 100, 101, 250]), rng.choice(["a", "a", "b", None]), rng.choice(["p", "p", "q", None, str(i)])) for i in range(600)]
    df = spark.createDataFrame(items, "doc_id long, size long, source string, cluster string")
    rows = packing.pack(df, capacity=100, group=200).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        if r.bin_no is not None:
            bins[r.bin_group, r.bin_no].append(r)
    of = {i: (n, s, c) for i, n, s, c in items}
    assert len({k[0] for k in bins}) == 3
    for i, (n, _, _) in of.items():
        parts = sorted(by[i], key=lambda r: r.start)
        assert sum(r.length for r in parts) == n and [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
    for parts in bins.values():
        assert sum(r.length for r in parts) <= 100
        clusters = [of[r.doc_id][2] for r in parts if of[r.doc_id][2]]
        assert len(clusters) == len(set(clusters))
        for source in {of[r.doc_id][1] for r in parts}:
            sizes = [r.length for r in parts if of[r.doc_id][1] == source]
            assert sum(sizes) - min(sizes) < 50 or len(sizes) == 1
    assert packing.pack(packing.items_of(docs)).select("doc_id").distinct().count() == len(corpus())
    assert packing.pack(df.where("false")).count() == 0


def test_packing_takes_the_tightest_compatible_bin():
    rng = random.Random(6)
    items = [(i, rng.randint(1, 60), rng.choice("ab"), rng.choice(["p", "q", None])) for i in range(300)]
    got = {(i, p): b for i, p, _, _, b in packing.pack_group(items, 100)}
    bins = []  # residual, clusters, fill by source
    for i, n, s, c in sorted(items, key=lambda x: (-x[1], x[0])):
        fit = [(b[0], k) for k, b in enumerate(bins) if b[0] >= n and c not in b[1] and b[2].get(s, 0) < 50]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([100, set(), {}])
        bins[k][0] -= n
        bins[k][1] |= {c} - {None}
        bins[k][2][s] = bins[k][2].get(s, 0) + n
        assert got[i, 0] == k


SECRETS = [
    ("assign", re.compile("(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[1]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def test_secret_scan(spark, docs):
    import pyarrow as pa

    rng = random.Random(1)
    parts = ["token", "secret", "Passwd", "api_key", "=", ":", " ", '"', "abc", "abcdef0123", "AKIA", "ABCDEFGHIJKLMNOPQ", "0123456789abcdef", "é", "\n", ".", "-"]
    texts = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["word " * 5000 + "token: abcdefgh " + "\n" * 3000]
    for text, spans in zip(texts, secret_scan.scan_column(pa.array(texts))):
        want = sorted((m.start(), k, m.end()) for k, (_, r, ok) in enumerate(SECRETS) for m in r.finditer(text or "") if ok(m))
        assert [s for s in spans if s[2] in secret_scan.BASE] == [(b, e, SECRETS[k][0]) for b, k, e in want]
    more = secret_scan.scan_column(pa.array(["x ghp_" + "Z" * 36, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890-abc"]))
    assert [s[0][2] for s in more] == ["github", "pem", "slack"]
    df = spark.createDataFrame([(1, "my token: abcdefgh é", 5, "s"), (2, None, None, "s")], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in secret_scan.redact(df).collect()}
    assert got[1].text == "my [SECRET] é" and got[1].n_chars == 13 and got[2].text is None and got[2].n_chars is None
    assert secret_scan.scan(empty(docs)).count() == 0 and secret_scan.scan(docs).count() == len(corpus())


def test_private_keys_are_redacted_whole():
    import pyarrow as pa

    rng = random.Random(4)
    body = ["".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(64)) for _ in range(5)] + ["abcDEF12=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    headers = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF", ""]
    cases = [(f"é {a}{gap.join(['', *more, *body, ''])}{z}", rest) for gap in ("\n", "\r\n", "\\n", " ") for more in ([], headers) for a, z, rest in [(begin, end, "\nHello - world"), (begin, "", "\n")] if gap == "\n" or z]
    for key, rest in cases:
        text = key.rstrip("\n") + rest
        assert secret_scan.masked(text, secret_scan.scan_column(pa.array([text]))[0]) == "é [SECRET]" + rest
    two = "\n".join([begin, *body, end, "some prose", begin, *body, end, "-----BEGIN CERTIFICATE-----"])
    assert secret_scan.masked(two, secret_scan.scan_column(pa.array([two]))[0]) == "[SECRET]\nsome prose\n[SECRET]\n-----BEGIN CERTIFICATE-----"
    prose = f"A line {begin} begins a key."
    assert secret_scan.masked(prose, secret_scan.scan_column(pa.array([prose]))[0]) == "A line [SECRET] begins a key."


def test_automaton():
    rules = [("ab(c|d)*e?", False), ("[x-z]{2,3}q+", True), ("a.c", False)]
    search = Automaton(rules, search=True)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdexyzXQq\n") for _ in range(rng.randint(0, 30))) for _ in range(800)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    for text, mask in zip(texts, search.masks(data, offsets, piece=4)):
        assert mask == sum(1 << i for i, (p, fold) in enumerate(rules) if re.search(p, text, re.I if fold else 0))


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def test_pii(spark, docs):
    rng = random.Random(3)
    parts = ["1", "2", "44", ".", ".", "-", " ", "@", "a", ".com", "+", "(", "é", "\U0001f600", "4111111111111111", "10.0.0.1", "x@y.zz", "\n", "_", "+33 "]
    texts = [None, "", "1 " * 9000, "a" * 20000 + "@b", "+1" + "(" * 9000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.scan(rows).collect()}
    for i, text in enumerate(texts):
        for kind, pattern, ok in PII:
            assert [(s.start, s.end) for s in got[i][kind]] == [m.span() for m in pattern.finditer(text or "") if ok(m[0])]
    more = spark.createDataFrame([(1, "my iban DE89370400440532013000"), (2, "ssn 123-45-6789, or DE89370400440532013001"), (3, "123-45-6789")], "doc_id long, text string")
    assert [(len(r.iban), len(r.ssn)) for r in pii.scan(more).orderBy("doc_id").collect()] == [(1, 0), (0, 1), (0, 0)]
    assert pii.scan(empty(docs)).count() == 0


def test_line_dedup(docs):
    rows = [(i, (t or "").split("\n")) for i, t in corpus()]
    seen = []
    for i, lines in rows:
        for k, line in enumerate(lines):
            words = frozenset(w for w in re.split("[\x20\x09-\x0d]+", line) if w)
            if words:
                seen.append(((i, k), words))
    alike = lambda s, t: 100 * len(s & t) >= 80 * len(s | t)
    gone = {p for p, s in seen if any(q < p and alike(s, t) for q, t in seen)}
    got = {(r.doc_id, k) for r in line_dedup.annotate(docs).collect() for k in r.removed}
    assert got == gone
    clean = line_dedup.deduplicated(docs)
    assert clean.columns == docs.columns
    text = {r.doc_id: r.text for r in clean.collect()}
    for (i, t), (_, lines) in zip(corpus(), rows):
        assert text[i] == (None if t is None else "\n".join(x for k, x in enumerate(lines) if (i, k) not in gone))
    assert line_dedup.annotate(empty(docs)).count() == 0


def test_line_dedup_links_and_classes(spark, tmp_path):
    base = [f"w{i}" for i in range(20)]
    lines = [" ".join(base[:k] + [f"v{k}x{j}"] + base[k + 1 :]) for k in range(20) for j in range(6)]  # 120 variants of a line
    texts = [*lines, "other words here\n" + lines[5], lines[7], None, "", "other words here\n" + lines[5]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    sets = {frozenset(x.split()) for t in texts if t for x in t.split("\n")}
    links = {s: sum(s != t and 100 * len(s & t) >= 80 * len(s | t) for t in sets) for s in sets}
    assert sum(links.values()) == 120 * 119
    got = {r.doc_id: r for r in line_dedup.op7_line_dedup(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_links == sum(links[frozenset(x.split())] for x in (t or "").split("\n") if x)
        assert got[i].class_id == (texts.index(t) if t else i)


def test_line_dedup_counts_links_of_large_groups_without_their_pairs(spark, monkeypatch):
    rng = random.Random(7)
    lines = [f"page {i} of the long book that we all read today" for i in range(150)]
    for size, far in ((36, 4), (70, 9)):  # variants up to and beyond what surely matches
        base = [f"{size}w{i}" for i in range(size)]
        for i in range(200):
            words = list(base)
            for k in range(rng.choice([0, 1, 1, 1, 2, 2, 3, far])):
                words[rng.randrange(len(words))] = f"v{i}x{k}"
            lines.append(" ".join(words + [f"more{i}"] * (i % 5 == 0)))
    sets = [frozenset(x.split()) for x in lines]
    classes = set(sets)
    links = {s: [t for t in classes if s != t and 100 * len(s & t) >= 80 * len(s | t)] for s in classes}
    made, write = {}, line_dedup.C.materialise

    def count(df, tag):
        out = write(df, tag)
        made[tag] = out.count()
        return out

    monkeypatch.setattr(line_dedup.C, "materialise", count)
    got = {r.doc_id: r for r in line_dedup.annotate(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert [got[i].n_links for i in range(len(lines))] == [len(links[s]) for s in sets]
    assert [bool(got[i].removed) for i in range(len(lines))] == [any(100 * len(s & t) >= 80 * len(s | t) for t in sets[:i]) for i, s in enumerate(sets)]
    every = sum(map(len, links.values())) // 2
    assert every > 30_000 and made["pairs"] + made["matching"] < every / 5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>A &amp; B</h1><p>First  paragraph,<br>of <b>some</b> length.<p>Second&nbsp;one.<div class="ad">Buy now.</div><p>Third.</article>
<div id=comments><p>Nice article, I liked it very much.</p></div><aside>More</aside><footer>&copy; 2020</footer><script>var x = "<p>no</p>"</script></body></html>"""


def test_html_text(spark):
    want = "A & B\n\nFirst paragraph, of some length.\n\nSecond one.\n\nThird."
    weights = html_text.train([PAGE] * 3)
    assert html_text.extract(PAGE) == want and html_text.extract(PAGE, weights) == want
    assert html_text.extract(None) == "" and html_text.extract("") == "" and html_text.extract("<p>") == ""
    assert html_text.extract("<article><p>An open comment comes.</p><!-- never closed <p>x</p>") == "An open comment comes."
    pages = spark.createDataFrame([(1, "u", PAGE, "text"), (2, None, None, "text")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.text_of(pages, weights).collect()}
    assert got[1].text == want and got[2].text == "" and got[2].url is None
    assert html_text.fit(pages.where("false")) == html_text.PLAIN


def test_names_around_the_article():
    text = "First paragraph of the article, of some length, with a second sentence. It ends here."
    page = '<html><body class="{}"><div id="page" class="{}"><nav><a href=a>One</a></nav><main class="{}"><article><p>{}</p></article></main><div class="sidebar"><p>Nothing of this, please, it is not text.</p></div></div></body></html>'
    for names in (("single right-sidebar", "", ""), ("", "menu-open", ""), ("", "", "has-sidebar"), ("", "", "")):
        assert html_text.extract(page.format(*names, text)) == text
        assert [b.inside and not b.outside for b in html_text.blocks_of(page.format(*names, text))] == [False, True, False]
    assert html_text.extract(f'<form class="ad"><main><p>{text}</p></main></form><div class="related"><p>More to read, here.</p></div>') == text
    two = f'<main><article><p>{text}</p></article></main><div class="related"><article><p>Another one, quite short.</p></article></div>'
    assert html_text.extract(two) == text
    assert html_text.extract(f"<div hidden><article><p>{text}</p></article></div>") == ""


def test_min_cut():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 7)
        source, sink = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 5)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda keep: sum(s for s, k in zip(source, keep) if not k) + sum(t for t, k in zip(sink, keep) if k) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: B023, E731
        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.min_cut(source, sink, edges)) == pytest.approx(best)


def test_lang_id(spark):
    sample = {"en": "the house and the river with this water that from was", "de": "der fluss und das haus mit nicht auch sich eine über", "fr": "les maisons avec une rivière dans cette eau qui était sur"}
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(sample[l].split(), k=20)), l) for i, l in enumerate(["en", "de", "fr"] * 60)]
    df = spark.createDataFrame(rows + [(900, None, "en"), (901, "no label", None)], "doc_id long, text string, lang string")
    model = lang_id.fit(df.where(~lang_id.held_out(F.col("doc_id"))))
    extra = spark.createDataFrame([(1000, None), (1001, ""), (1002, "123 !?"), (1003, "the river and the house " * 9 + "der fluss und das haus " * 30)], "doc_id long, text string")
    got = {r.doc_id: r for r in lang_id.label(df.select("doc_id", "text").union(extra), model).collect()}
    held = [(i, l) for i, _, l in rows if df.where(f"doc_id = {i}") is not None and __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == l for i, l in held) >= 0.98 * len(held)
    assert [got[i].lang_pred for i in (900, 1000, 1001, 1002)] == ["und"] * 4 and got[1000].score == 0
    assert got[1003].lang_pred == "de" and 0.5 < got[1003].score < 1
    assert lang_id.train([], []).label(["text"]) == (["und"], [0.0])
    kept = lang_id.accepted(df, model)
    assert kept.columns == df.columns and kept.where("doc_id = 900").count() == 0 and kept.where("doc_id < 180").count() == 180


def test_rare_languages_are_learned(spark):
    words = {"en": "the house and the river with this water", "de": "der fluss und das haus mit nicht auch", "fi": "talo ja joki tämä vesi oli myös kanssa"}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words[l].split(), k=20)), l) for i, l in enumerate(["en", "de"] * 300 + ["fi"] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(df, sample=40)
    assert model.languages == ["de", "en", "fi"]
    got = {r.doc_id: r.lang_pred for r in lang_id.label(df, model).collect()}
    assert [got[i] for i in (600, 601, 602)] == ["fi"] * 3


def test_forward_backward_against_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    unary, moves = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    want, total = np.zeros((4, 3)), 0
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(sum(unary[0, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += w
        for t, y in enumerate(path):
            want[t, y] += w
    assert np.allclose(lang_id.forward_backward(unary, moves, np.array([4]))[0][0], want / total)


def test_ann(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 16)).round(3)
    x[7] = x[8] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [1.0, None] + [0.0] * 14), (5003, [float("nan")] * 16), (5050, [float("inf")] * 16), (5004, []), (5005, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    assert sorted(got) == list(range(0, 1200, 50))
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(1200), -s.round(12)))[:5]
        hits += len(set(best.tolist()) & {i for _, i, _ in found})
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s[i] - v) < 1e-9 for _, i, v in found)
    assert hits >= 0.9 * 5 * len(got)
    assert [i for _, i, _ in got[100][:2]] == [7, 8]
    few = ann.nearest(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2)]
    assert ann.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_ann_among_near_and_exact_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 16))
    x[1000:3000] = x[1000] + rng.normal(size=(2000, 16)) * 1e-3  # a third near copies
    x[3000:3300] = x[3000]  # exact copies
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].add(r.vec_id)
    for q in range(0, 6000, 50):
        s = (unit * unit[q]).sum(axis=1).round(12)
        s[q] = -9
        assert got[q] == set(np.lexsort((np.arange(6000), -s))[:5].tolist())


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, t, ["en", None][i % 2], f"src{i % 3}", len(t or "")) for i, t in corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = dict(corpus())
    left = {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    by = {}
    for i in sorted(left, key=lambda i: (-len(texts[i]), i)):
        by.setdefault(re.sub("[\x20\x09-\x0d]", "", texts[i]), i)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert sorted(docs.columns) == sorted(df.columns)
        got = {r.doc_id for r in docs.collect()}
        if name == "language":
            assert got == left
        if name == "exact":
            assert got == set(by.values())
        if name == "near":
            sets = {i: shingle_set(texts[i], 5) for i in by.values()}
            assert all(any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets if j != i) for i in set(by.values()) - got)
            near = [(i, j) for i in got for j in got if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
            assert not near
    packed = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == got
