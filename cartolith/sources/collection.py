"""FeatureCollections of any length, read by many tasks: no task holds more than one feature and a batch of rows.

Spark's text reader splits a file at `}`, so that a row ends with each of them, from any store. A split can begin inside
a text or at any depth. One pass sums up what each split does to both, whichever it begins with; the driver adds that up.
A second pass takes from each split the end of the feature that it begins in, the start of the feature that it ends in and
what lies outside `features`. The driver puts those together: the features over borders, and the document without features.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import FormatError

_text = r'"[^"\\]*(?:\\.[^"\\]*)*"'
PLAIN = re.compile(_text + r'|[^"{}\[\]]+', re.S)
CLOSE = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
TOKEN = re.compile(_text + r"|[{}\[\]:]", re.S)
BLANK = " \t\r\n"


@functools.lru_cache(4096)
def _profile(brackets: str) -> tuple[int, int]:
    """Change of depth over brackets, and the least on the way."""
    depth = low = 0
    for c in brackets:
        depth += 1 if c in "{[" else -1
        low = min(low, depth)
    return depth, low


def step(text: str, inside: bool, depth: int) -> tuple[bool, int, int]:
    """Whether a text is open behind a row, the depth there, and the least depth in it."""
    if inside:
        m = CLOSE.match(text)
        if not m:
            return True, depth, depth
        text = text[m.end() :]
    left = PLAIN.sub("", text)
    cut = left.find('"')
    change, low = _profile(left if cut < 0 else left[:cut])
    return cut >= 0, depth + change, depth + low


def _features_at(text: str, inside: bool, depth: int) -> int | None:
    """Where the array `features` of the document begins in a row, behind its bracket."""
    opened = CLOSE.match(text) if inside else None
    if inside and not opened:
        return None
    before = ("", "")
    for m in TOKEN.finditer(text, opened.end() if opened else 0):
        token = m[0]
        if token == "[" and depth == 1 and before[1] == ":" and before[0][:1] == '"' and _loads(before[0]) == "features":
            return m.end()
        depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(token, 0)
        before = (before[1], token)
    return None


def _loads(text: str):
    try:
        return json.loads(text)
    except ValueError as e:
        raise FormatError(f"not JSON: {e}: {text[:60]!r}") from None


def pieces(rows, inside: bool, depth: int, region: str | None):
    """(kind, text) over the rows of a split: outside; lead, the end of a feature from before; first and feature; cut, one
    that does not end here; bad, what ends the array inside an element; the region at the end comes last. Region None: nothing is looked for."""
    lead, buffer, first = region == "features" and depth > 2, [], False
    for text in rows:
        before, within = depth, inside
        inside, depth, low = step(text, inside, depth)
        if region == "outside" and low <= 1:
            at = _features_at(text, within, before)
            if at is not None:
                yield "outside", text[:at]
                text, region, first = text[at:], "features", True
        if region != "features":
            yield "outside", text
            continue
        if not buffer and not lead and text.lstrip(BLANK)[:1] == "]":
            region = "outside"
            if _features_at(text, False, 2) is not None:
                raise FormatError("two members named features")
            yield "outside", text
            continue
        buffer.append(text)
        if depth < 2:
            yield "bad", text[:60]
            buffer, lead, first, region = [], False, False, "outside"
            continue
        if depth == 2:
            yield "lead" if lead else "first" if first else "feature", "".join(buffer)
            buffer, lead, first = [], False, False
    if buffer or lead:
        yield "lead cut" if lead else "first cut" if first else "cut", "".join(buffer)
    yield "region", region


def _splits(batches, last: set):
    """(key, rows) for each split of a file; rows end with their `}`, except the last row of those splits in `last`."""
    held: list = [None, None]  # the row that came last: its end is known when the next one comes

    def rows():
        for batch in batches:
            yield from zip(zip(batch.column("file").to_pylist(), batch.column("at").to_pylist()), batch.column("value").to_pylist())

    source = rows()
    held[:] = next(source, (None, None))

    def own(key):
        while held[0] == key:
            text = held[1]
            held[:] = next(source, (None, None))
            yield text if held[0] != key and key in last else text + "}"

    while held[0] is not None:
        key = held[0]
        mine = own(key)
        yield key, mine
        for _ in mine:  # what was not read of it
            pass


def _summed(batches):
    import pyarrow as pa

    for key, rows in _splits(batches, set()):
        n, ends = 0, [(False, 0), (True, 0)]
        for text in rows:
            n += len(text) if text.isascii() else len(text.encode("utf-8"))
            ends = [step(text, *e)[:2] for e in ends]
        yield pa.RecordBatch.from_pylist([{"file": key[0], "at": key[1], "found": json.dumps([n, *ends])}])


def _bordering(starts: dict, last: set):
    def run(batches):
        import pyarrow as pa

        for key, rows in _splits(batches, last):
            got: dict = {"outside": [], "lead": "", "ended": True, "cut": None, "bad": None}
            for kind, text in pieces(rows, *starts[key]):
                if kind == "outside":
                    got["outside"].append(text)
                elif kind in ("lead", "lead cut"):
                    got["lead"], got["ended"] = text, kind == "lead"
                elif kind in ("cut", "first cut"):
                    got["cut"] = text
                elif kind in ("region", "bad"):
                    got[kind] = text
            yield pa.RecordBatch.from_pylist([{"file": key[0], "at": key[1], "found": json.dumps(got)}])

    return run


def _written(starts: dict, last: set, tails: dict, whole: dict):
    def run(batches):
        import pyarrow as pa

        out: list = []

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["feature"])
            out.clear()
            return made

        for key, rows in _splits(batches, last):
            if key[0] in whole:
                out.extend([whole[key[0]]] if key[1] == 0 else [])
                continue
            for kind, text in pieces(rows, *starts[key]):
                if kind not in ("first", "feature", "first cut", "cut"):
                    continue
                text = (text + tails[key] if "cut" in kind else text).lstrip(BLANK)
                if "first" not in kind:
                    if text[:1] != ",":
                        raise FormatError(f"not JSON: no comma before {text[:60]!r}")
                    text = text[1:]
                out.append(json.dumps(_loads(text), ensure_ascii=False))
                if len(out) >= 8192:
                    yield batch()
        yield batch()

    return run


def read(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """A column `feature` of JSON texts, and what the first file holds besides its features."""
    text = spark.read.text(path, lineSep="}")
    files = len(text.inputFiles())
    text = text.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size"))
    sizes = {r["file"]: r["size"] for r in text.select("file", "size").distinct().collect()} if files > 1 else {r["file"]: r["size"] for r in text.select("file", "size").limit(1).collect()}
    if len(sizes) != files:
        raise FormatError("not JSON: an empty file")
    # the same splits in every pass, whatever the cluster has by then
    kind = T.StructType([T.StructField("value", T.StringType()), T.StructField("file", T.LongType()), T.StructField("at", T.LongType())])
    rows = DataFrame(spark._jsparkSession.createDataFrame(text.drop("size")._jdf.toJavaRDD(), spark._jsparkSession.parseDataType(kind.json())), spark)

    def passed(run) -> dict:
        return {(r["file"], r["at"]): json.loads(r["found"]) for r in rows.mapInArrow(run, "file long, at long, found string").collect()}

    sums = passed(_summed)
    order = sorted(sums)
    starts, last = {}, set()
    for i, key in enumerate(order):
        if not i or order[i - 1][0] != key[0]:
            inside, depth, total = False, 0, 0
        starts[key] = (inside, depth, "features" if depth >= 2 else "outside")
        n, *ends = sums[key]
        total += n
        inside, change = ends[inside]
        depth += change
        if i + 1 == len(order) or order[i + 1][0] != key[0]:  # each row counted one byte for its `}`; the reader leaves out a mark of the byte order
            over = total - sizes[key[0]]
            if over in (1, -2) or over not in (0, -3) and depth != 0:
                last.add(key)
    plain: set = set()
    while True:
        found = passed(_bordering(starts, last))
        again = False
        for i, key in enumerate(order):
            if not i or order[i - 1][0] != key[0]:
                region = None if key[0] in plain else "outside"
            inside, depth, assumed = starts[key]
            if region != assumed:
                starts[key], again = (inside, depth, region), True
            else:
                region = found[key]["region"]
        if again:
            continue
        if bad := [x["bad"] for x in found.values() if x["bad"] is not None]:
            raise FormatError(f"not JSON, or no features: {bad[0]!r}")
        outside: dict = {}
        for key in order:
            outside[key[0]] = outside.get(key[0], "") + "".join(found[key]["outside"])
        whole = {}
        for name, rest in outside.items():
            document = _loads(rest.removeprefix("\ufeff"))
            if isinstance(document, dict) and document.get("type") == "Feature":
                whole[name] = rest.removeprefix("\ufeff")
            elif not isinstance(document, dict) or not isinstance(document.get("features"), list):
                raise FormatError("no FeatureCollection")
        if set(whole) <= plain or all(isinstance(_loads(whole[n]).get("features"), type(None)) for n in set(whole) - plain):
            break
        plain |= set(whole)  # a feature with a member of that name is taken whole
        starts = {k: (*v[:2], None if k[0] in plain else v[2]) for k, v in starts.items()}
    tails = {}
    for i, key in enumerate(order):
        if found[key]["cut"] is not None:
            tails[key] = ""
            for after in order[i + 1 :]:
                if after[0] != key[0]:
                    break
                tails[key] += found[after]["lead"]
                if found[after]["ended"]:
                    break
    return rows.mapInArrow(_written(starts, last, tails, whole), "feature string"), outside[order[0][0]].removeprefix("\ufeff")
