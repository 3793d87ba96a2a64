"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (numeric range of address parts, Luhn for
cards, mod-97 for IBANs, digit counts for phones), and context words in the NEAR characters before a span
(since the last match of its kind) raise its score. Base kinds (email, ip, card, phone) are spans as soon as they are confirmed; further
kinds (iban, ssn) need a score of at least LEAST.

Matches of a kind are leftmost and do not overlap; matches that fail their validator are dropped and not
tried again. The patterns are written so that each run of characters is read once: a match begins where a
run begins or where the last match ended (\\G), and repetitions do not give back what they took, which
changes none of the matches but keeps very long texts linear and off the stack.

Positions come from the pieces of text between the matches, in code points, with an exclusive end. They are summed
in parts of PART matches, so that the work stays in proportion to the matches of a text.

Edge cases: a null text counts as empty and has no spans. Texts are read whole. Equal rows give equal
results, whatever their ids (a null id stays null); input columns other than the id and the text, whatever their
names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9_])",
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
}
#: Cheap conditions without which a kind cannot occur in a text.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9\\x20-]{11}", "phone": "+", "iban": "[A-Z]{2}[0-9]{2}[A-Z0-9]{11}", "ssn": "[0-9]-[0-9]{2}-[0-9]"}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": "mail|contact|write|adress|correo|courriel",
    "ip": r"(?<![a-z0-9_])ip(?![a-z0-9_])|host|server|address|network",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|anruf",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": r"(?<![a-z0-9_])ssn(?![a-z0-9_])|social security|insurance",
}
BASE, KINDS, LEAST, NEAR, PART = ("email", "ip", "card", "phone"), tuple(PATTERNS), 0.5, 40, 128
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes Luhn's check."""
    turned = F.reverse(digits)
    value = lambda i: F.substr(turned, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + doubled(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes its check."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    code = lambda i: F.ascii(F.substr(moved, i, F.lit(1)))
    step = lambda acc, i: F.when(code(i) < 58, acc * 10 + code(i) - 48).otherwise(acc * 100 + code(i) - 55) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


ENTRIES = "array<struct<m:string,start:int,end:int,near:string>>"


def _placed(kind: str, pairs: Column, begin: Column) -> Column:
    """Confirmed matches with their positions; pairs: gap (characters before a match), near (the last of them), m; begin: where they begin."""
    step = lambda acc, x: acc["at"] + x["gap"] + F.length(x["m"])
    entry = lambda acc, x: F.struct(x["m"].alias("m"), (acc["at"] + x["gap"]).alias("start"), step(acc, x).alias("end"), x["near"].alias("near"))
    return F.aggregate(
        pairs,
        F.struct(begin.alias("at"), F.array().cast(ENTRIES).alias("out")),
        lambda acc, x: F.struct(step(acc, x).alias("at"), F.when(confirmed(kind, x["m"]), F.array_append(acc["out"], entry(acc, x))).otherwise(acc["out"]).alias("out")),
    )["out"]


def proposed(text: Column, kind: str) -> Column:
    """Matches of a kind as structs of text, start, end and the text before; an array without entries if it cannot occur."""
    pieces, matches = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    pairs = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(NEAR)).alias("near"), m.alias("m")))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / PART).cast("int")), lambda i: F.slice(pairs, i * PART + 1, F.lit(PART)))
    lengths = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x["gap"] + F.length(x["m"])))
    begins = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    parted = F.flatten(F.zip_with(parts, F.slice(begins, 1, F.size(parts)), lambda part, begin: _placed(kind, part, begin)))
    hint = F.contains(text, F.lit(HINTS[kind])) if kind in ("email", "phone") else text.rlike(HINTS[kind])
    few = F.regexp_count(text, F.lit(PATTERNS[kind])) <= PART
    return F.when(hint, F.when(few, _placed(kind, pairs, F.lit(0))).otherwise(parted)).otherwise(F.array().cast(ENTRIES))


def scored(kind: str, found: Column) -> Column:
    def span(x):
        score = F.lit(SCORES[kind]) + F.when(F.lower(x["near"]).rlike(CONTEXT[kind]), 0.2).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))

    spans = F.transform(found, span)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= LEAST)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, for each kind, an array of spans (kind, start, end, score)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[proposed(F.col("text"), k).alias(f"found_{k}") for k in KINDS])
    return rows.select("doc_id", *[scored(k, F.col(f"found_{k}")).alias(k) for k in KINDS])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    rows = scan(C.table(spark, sf_dir, "documents"))
    n = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *n, _joined(F.concat(*BASE)).alias("base"), _joined(F.concat(*KINDS)).alias("spans")).select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans"
    )
