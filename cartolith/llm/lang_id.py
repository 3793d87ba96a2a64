"""Language of texts from a linear-chain conditional random field over their words.

Every word gets a language: the field's unary weights belong to character n-grams of the word with its
borders (so that prefixes and suffixes are features of their own) and to an entry for the whole word (the
lexicon), all hashed into one table; its transition weights are learned with them. Forward-backward over the
whole text gives each word's probabilities; the text's language has the largest sum of
them, weighted by the letters of the words, and the score is its share. A long text goes through in runs of RUN
words side by side: products of transitions over whole runs carry what lies before and after to their borders, so
that the result is that of one chain.

Training reads at most SAMPLE labelled texts, those with the smallest hash of their id and text, and besides up to RARE
texts of each language, one for each remainder of the hash, so that no labelled language is missing however
large the table; all words of each. Besides plain chains it sees chains that change language, put together from
two texts, so that the transitions describe code-switched text. Words are runs of letters (as str.isalpha has
them), in lower case.

Edge cases: null, empty and letterless texts are `und` with score 0. Rows with a null text or language
take no part in training; with no training rows everything is `und`. With a single language everything
with letters gets that. Equal texts get equal results, whatever their id or other columns. Ties go to the
language that sorts first. Texts are read whole. A null id is not held out; other input columns are ignored by
label() and kept by accepted(). An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

SAMPLE = 2000  # training texts at most
RARE = 64  # training texts besides for each language that has fewer in the sample
BITS = 17  # of the table of features
RUN = 64  # words of a text that are worked through one after another
EPOCHS, RATE, DECAY = 1, 0.35, 1e-6
WORDS_KEPT = 300_000  # in a worker's table of words it has seen
UNKNOWN = "und"

_word = re.compile(r"[^\W\d_]+")  # letters, and numerals such as fractions, which words_of() takes out


def words_of(text: str) -> list[str]:
    """Runs of letters (characters of which str.isalpha holds), in lower case."""
    words = _word.findall(text.lower())
    if words and not "".join(words).isalpha():
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return words


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, one after another, and where those of each word begin."""
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = codes == 2
    word = np.cumsum(first) - 1
    mult = np.uint64(0x9E3779B97F4A7C15)
    out, owner = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        h = h[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1 :]
        whole = word[: len(h)] == word[n - 1 :]
        out.append((h[whole] + np.uint64(n)) * mult)
        owner.append(word[: len(h)][whole])
    place = np.arange(len(codes)) - np.flatnonzero(first)[word]
    with np.errstate(over="ignore"):
        each = codes * (place.astype(np.uint64) * np.uint64(2_654_435_761) + np.uint64(0xD6E8FEB86659FD93))
        out.append((np.add.reduceat(each ^ (each >> np.uint64(29)), np.flatnonzero(first)) + np.uint64(77)) * mult)
    owner.append(np.arange(len(words)))
    ids, owner = np.concatenate(out) >> np.uint64(64 - BITS), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order].astype(np.int32), np.searchsorted(owner[order], np.arange(len(words)))


def forward_backward(unary: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each label at each place, and expected transitions of all chains.

    unary: chains x places x labels (logarithms), moves: labels x labels (logarithms). Places from a chain's
    length on are padding and get no probability.
    """
    chains, places, k = unary.shape
    e = np.exp(unary - unary.max(axis=2, keepdims=True))
    a = np.exp(moves)
    live = np.arange(places)[None, :] < lengths[:, None]
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, places):
        x = (alpha[:, t - 1] @ a) * e[:, t]
        alpha[:, t] = x / x.sum(axis=1, keepdims=True)
    for t in range(places - 2, -1, -1):
        x = (beta[:, t + 1] * e[:, t + 1]) @ a.T
        beta[:, t] = np.where(live[:, t + 1, None], x / x.sum(axis=1, keepdims=True), 1.0)
    p = alpha * beta
    p = p / p.sum(axis=2, keepdims=True) * live[:, :, None]
    expected = np.zeros((k, k))
    for t in range(1, places):
        pair = alpha[:, t - 1, :, None] * a[None] * (e[:, t] * beta[:, t])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        expected += pair[live[:, t]].sum(axis=0)
    return p, expected


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, moves: np.ndarray):
        self.languages, self.table, self.moves = languages, table.astype(np.float32), moves
        self._place: dict[str, int] = {}
        self._unary = np.zeros((0, len(languages)), np.float32)

    def unary(self, words: list[str]) -> np.ndarray:
        ids, begin = features(words)
        return np.add.reduceat(self.table[ids], begin, axis=0)

    def rows(self, words: list[str]) -> np.ndarray:
        """Unary weights of each word, from the table of words seen before."""
        known = self._place
        fresh = [w for w in set(words) if w not in known]
        if fresh:
            if len(known) + len(fresh) > WORDS_KEPT:
                known.clear()
                self._unary = self._unary[:0]
                fresh = list(set(words))
            at = len(known)
            known.update(zip(fresh, range(at, at + len(fresh))))
            parts = [self.unary(fresh[i : i + 20_000]) for i in range(0, len(fresh), 20_000)]
            self._unary = np.concatenate([self._unary, *parts])
        return self._unary[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lists = [words_of(x) if x else [] for x in texts]
        n = np.array([len(x) for x in lists])
        score = np.zeros((len(texts), len(self.languages)))
        if n.sum() and self.languages:
            flat = [w for x in lists for w in x]
            weight = np.fromiter(map(len, flat), np.float64, len(flat))
            probability = self._probabilities(self.rows(flat), n)
            some = n > 0
            score[some] = np.add.reduceat(probability * weight[:, None], (np.cumsum(n) - n)[some], axis=0)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total = score.sum(axis=1)
        best = score.argmax(axis=1)
        lang = [self.languages[b] if t > 0 else UNKNOWN for b, t in zip(best, total)]
        return lang, [float(min(1.0, s[b] / t)) if t > 0 else 0.0 for s, b, t in zip(score, best, total)]

    def _probabilities(self, unary: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probabilities of all words of texts of n words each: one chain a text, worked through in runs side by side."""
        per = -(-n // RUN)
        text = np.repeat(np.arange(len(n)), per)
        rank = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        begin = (np.cumsum(n) - n)[text] + rank * RUN
        length = np.minimum(RUN, n[text] - rank * RUN)
        k = len(self.moves)
        before, after = np.ones((k, len(text))), np.ones((k, len(text)))
        order = np.argsort(-length, kind="stable")
        of_long = order[per[text[order]] > 1]
        if len(of_long):
            products = np.empty((k, k, len(text)))
            for i in range(0, len(of_long), 2048):
                take = of_long[i : i + 2048]
                products[:, :, take] = _product(*_runs(unary, begin[take], length[take])[:2], self.moves, rank[take] == 0)
            _borders(products, rank, per[text], before, after)
        out = np.empty(unary.shape)
        for i in range(0, len(order), 2048):
            take = order[i : i + 2048]
            e, alive, at = _runs(unary, begin[take], length[take])
            p = _marginals(e, alive, self.moves, rank[take] == 0, before[:, take], after[:, take])
            live = at >= 0
            out[at[live]] = p.transpose(0, 2, 1)[live]
        return out

    def pack(self) -> dict:
        return {"languages": self.languages, "table": base64.b64encode(zlib.compress(self.table.tobytes(), 1)), "moves": self.moves.tolist()}

    @classmethod
    def unpack(cls, x: dict) -> Model:
        k = len(x["languages"])
        table = np.frombuffer(zlib.decompress(base64.b64decode(x["table"])), np.float32).reshape(-1, max(k, 1))
        return cls(x["languages"], table, np.array(x["moves"]).reshape(k, k))


def _runs(unary: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of runs, the longest first (places x labels x runs, each place's largest 1); how many runs have a word at
    each place; and where the words are (places x runs, -1 past the end)."""
    places = np.arange(int(length[0]))[:, None]
    at = np.where(places < length, begin + places, -1)
    e = np.ascontiguousarray(unary[at].transpose(0, 2, 1), np.float64)
    return np.exp(e - e.max(axis=1, keepdims=True)), (at >= 0).sum(axis=1), at


def _product(e: np.ndarray, alive: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run the product of its transitions and weights (labels x labels x runs), from the word before it to its
    last word; for a text's first run, which no word comes before, all rows are alike."""
    turned = np.exp(moves).T
    m = np.where(first, 1.0, np.exp(moves)[:, :, None]) * e[0]
    for t in range(1, len(e)):
        r = alive[t]
        x = np.matmul(turned, m[:, :, :r]) * e[t, :, :r]
        m[:, :, :r] = x / x.max(axis=(0, 1)) if t % 4 == 0 else x
    return m / m.max(axis=(0, 1))


def _borders(products: np.ndarray, rank: np.ndarray, runs: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
    """For all runs of texts, in order: the forward weights of the word before each, the backward weights of its last word."""
    left = runs - 1 - rank
    for r in range(1, int(rank.max()) + 1):
        at = np.flatnonzero(rank == r)
        x = np.einsum("in,ijn->jn", before[:, at - 1], products[:, :, at - 1])
        before[:, at] = x / x.sum(axis=0)
    for r in range(1, int(left.max()) + 1):
        at = np.flatnonzero(left == r)
        x = np.einsum("ijn,jn->in", products[:, :, at + 1], after[:, at + 1])
        after[:, at] = x / x.sum(axis=0)


def _marginals(e: np.ndarray, alive: np.ndarray, moves: np.ndarray, first: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Probabilities in runs, given what comes to them from before their first and after their last word."""
    a = np.exp(moves)
    alpha, beta = np.ones_like(e), np.empty_like(e)
    alpha[0] = np.where(first, 1.0, a.T @ before) * e[0]
    for t in range(1, len(e)):
        r = alive[t]
        x = (a.T @ alpha[t - 1, :, :r]) * e[t, :, :r]
        alpha[t, :, :r] = x / x.sum(axis=0)
    beta[:] = after
    for t in range(len(e) - 2, -1, -1):
        r = alive[t + 1]
        x = a @ (beta[t + 1, :, :r] * e[t + 1, :, :r])
        beta[t, :, :r] = x / x.sum(axis=0)
    alpha *= beta
    return alpha / alpha.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Maximum likelihood by Adagrad over chains of 16 words, half of them of two languages."""
    languages = sorted(set(langs))
    k = len(languages)
    if k < 2:
        return Model(languages, np.zeros((1 << BITS, max(k, 1))), np.zeros((k, k)))
    rng = np.random.default_rng(seed)
    by: list[list[list[str]]] = [[] for _ in languages]
    for text, lang in zip(texts, langs):
        words = words_of(text)
        by[languages.index(lang)] += [words[i : i + 16] for i in range(0, len(words), 16)]
    most = max(map(len, by))
    chains, labels = [], []
    for lang, parts in enumerate(by):  # rare languages are repeated up to a fifth of the most frequent one
        repeat = max(1, min(10, most // (5 * max(1, len(parts)))))
        for part in parts * repeat:
            other = int(rng.integers(k))
            if rng.random() < 0.5 and by[other]:
                tail = by[other][int(rng.integers(len(by[other])))]
                half = int(rng.integers(1, 15))
                part, lab = part[:half] + tail[: 16 - half], [lang] * len(part[:half]) + [other] * len(tail[: 16 - half])
            else:
                lab = [lang] * len(part)
            if part:
                chains.append(part)
                labels.append(lab)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for c in chains for w in c))}
    ids, begin = features(list(vocabulary))
    end = np.append(begin[1:], len(ids))
    table, moves = np.zeros((1 << BITS, k)), np.zeros((k, k))
    grown, grown_moves = np.full(table.shape, 1e-2), np.full(moves.shape, 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for i in range(0, len(order), 256):
            take = order[i : i + 256]
            n = np.array([len(chains[j]) for j in take])
            word = np.array([vocabulary[w] for j in take for w in chains[j]])
            gold = np.array([x for j in take for x in labels[j]])
            live = np.arange(16)[None, :] < n[:, None]
            unique, back = np.unique(word, return_inverse=True)
            span = end[unique] - begin[unique]
            own = np.repeat(np.arange(len(unique)), span)
            f = ids[np.arange(len(own)) - np.repeat(np.cumsum(span) - span, span) + np.repeat(begin[unique], span)]
            weights = np.add.reduceat(table[f], np.cumsum(span) - span, axis=0)
            unary = np.zeros((len(take), 16, k))
            unary[live] = weights[back]
            p, expected = forward_backward(unary, moves, n)
            wrong = p[live]
            wrong[np.arange(len(gold)), gold] -= 1
            lab = np.full(live.shape, -1)
            lab[live] = gold
            both = live[:, 1:]
            np.subtract.at(expected, (lab[:, :-1][both], lab[:, 1:][both]), 1)
            by_word = np.zeros((len(unique), k))
            np.add.at(by_word, back, wrong)
            cells, at = np.unique(f, return_inverse=True)
            slope = np.stack([np.bincount(at, by_word[own, c], len(cells)) for c in range(k)], axis=1) / len(take) + DECAY * table[cells]
            grown[cells] += slope**2
            table[cells] -= RATE * slope / np.sqrt(grown[cells])
            expected /= len(take)
            grown_moves += expected**2
            moves -= RATE * 0.3 * expected / np.sqrt(grown_moves)
    return Model(languages, table, moves)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` rows of labelled, chosen by a hash of the id (a top-k, no sort of all), and up to RARE of each language with fewer of them."""
    rows = labelled.where(labelled[text_col].isNotNull() & labelled[lang_col].isNotNull()).select(
        labelled[text_col].alias("text"), labelled[lang_col].alias("lang"), F.xxhash64(labelled[id_col].cast("string"), labelled[text_col], labelled[lang_col]).alias("h")
    )
    found = sorted(C.smallest(rows, "h", sample), key=lambda r: (r["h"], r["text"]))
    if len(found) == sample:
        seen = Counter(r["lang"] for r in found)
        least = rows.groupBy("lang", F.pmod("h", F.lit(RARE)).alias("slot")).agg(F.min("h").alias("h")).collect()
        known = {(r["lang"], r["h"]) for r in found}
        more = [(r["lang"], r["h"]) for r in least if seen[r["lang"]] < RARE and (r["lang"], r["h"]) not in known]
        if more:
            wanted = F.broadcast(labelled.sparkSession.createDataFrame(more, "lang string, h long"))
            found += sorted(rows.join(wanted, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text")).collect(), key=lambda r: (r["h"], r["text"]))
    return train([r["text"] for r in found], [r["lang"] for r in found])


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 2 when divided by 4 (a null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_models: dict[int, Model] = {}


def _of(packed: dict) -> Model:
    key = hash(packed["table"])
    if key not in _models:
        _models.clear()
        _models[key] = Model.unpack(packed)
    return _models[key]


def _label(packed):
    def run(batches):
        model = _of(packed.value)
        for batch in batches:
            lang, score = [], []
            for i in range(0, batch.num_rows, 512):
                a, b = model.label(batch.column(1).slice(i, 512).to_pylist())
                lang += a
                score += b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row. The model's size is fixed by BITS and the number of languages."""
    C.prepare(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast(model.pack())
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_label(packed), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that have letters and whose language's share is not below least, with all columns."""
    C.prepare(docs.sparkSession)
    packed, at = docs.sparkSession.sparkContext.broadcast(model.pack()), docs.columns.index(text_col)

    def run(batches):
        model = _of(packed.value)
        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, 512):
                lang, score = model.label(batch.column(at).slice(i, 512).to_pylist())
                keep += [a != UNKNOWN and b >= least for a, b in zip(lang, score)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_lang_id(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(docs.doc_id)))
    ids = docs.select("doc_id", "text")
    return label(ids, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
