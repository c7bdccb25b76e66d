"""Toxicity scores of texts restored through a noisy channel.

1. A character language model (4-grams over letters, anything else is a break) is counted over all
   documents: each task counts its texts into one fixed table, tables are summed, the result is
   at most 27^4 rows however large the corpus is.
2. Suspicious spellings are decoded: a Viterbi search over the lattice of readings (look-alike digits
   and signs, separators inside a word, repeated letters) finds the likeliest letters under the
   language model and the channel's costs. Tokens with a single reading are their own restoration.
3. Restored texts become sets of words. A logistic model with L2 is fitted on the labelled rows:
   at most `max_rows` of them, by a hash of doc_id, and the `max_features` words and word beginnings
   with the highest chi-square. The score is the larger of the model's probability and the best lower
   bound of the toxic share that a single feature has among training rows: features that nearly always
   come together share their weight in the model, and one of them alone would say too little.

Labels enter the training only, and only from rows outside the held-out quarter; lang, source and
doc_id are never inputs of a score.

Edge cases: null and empty texts get the score of the intercept; texts are scored whole; repeated rows and
ties get equal scores; documents without labels are scored like any other; without training rows or with
a single class the score is the (smoothed) share of toxic training rows; labels of documents that do not
exist and rows with null labels or ids are ignored, repeated labels of a document count once (the larger);
extra columns pass through ``score`` unless they have the names it adds; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm._common import Scratch, arrow_rows, small, table

#: Bounds of the labelled rows the model is fitted on and of the words it weighs.
MAX_ROWS, MAX_FEATURES = 20_000, 500
THRESHOLD = 0.3
#: Lengths of the word beginnings that are features: languages that derive words share them.
BEGINNINGS = (4, 6)
#: A feature whose toxic share is at least PURE vouches alone for the lower Wilson bound of that share, at so many
#: standard deviations.
WILSON, PURE = 4.0, 0.9
ORDER = 4
SYMBOLS = 27  # a-z and break
#: Look-alikes of letters.
READINGS = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
}
SEPARATORS = ".-_*~'`^ "
EDGES = ".,;:!?\"'()[]{}<>*#&%$+=~^|_-/\\…“”‘’«»¡¿"
#: Single characters set apart by one blank each, three or more in a row; punctuation may close the row.
SPACED = re.compile(r"(?<![^\s\"'(])[^\W_](?: [\w@$!|+€£](?![^\s.,;:!?\"')])){2,}")
REPEATED = re.compile(r"([^\W\d_])\1\1")
PARTS = re.compile(r"[\W\d_]+")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Signs that may stand for a last letter, what may just be punctuation around it.
SIGNS, QUOTES = "$@€£", ".,;:?\"'()[]{}<>"
#: Lattice steps after which a decoding settles on its best reading so far, and the longest token whose reading is remembered.
SETTLE, REMEMBERED = 256, 64


def classes():
    """Lookup from byte to symbol: letters 1-26, anything else 0."""
    import numpy as np

    look = np.zeros(256, np.int64)
    for i in range(26):
        look[97 + i] = look[65 + i] = i + 1
    return look


def count_ngrams(texts: DataFrame, text: str = "text") -> DataFrame:
    """(code, n): how often each 4-gram of symbols occurs in all texts. At most 27^4 rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        look, total = classes().astype(np.int32), np.zeros(SYMBOLS**ORDER, np.int64)

        def add(piece: list[bytes]) -> None:
            s = look[np.frombuffer(b"\0\0\0" + b"\0\0\0".join(piece) + b"\0", np.uint8)]
            code = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
            total[:] += np.bincount(code, minlength=total.size)

        piece, held = [], 0
        for (body,) in arrow_rows(batches, "text"):
            piece.append(body)
            held += len(body)
            if held >= 1 << 21:
                add(piece)
                piece, held = [], 0
        if piece:
            add(piece)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["code", "n"])

    return texts.select(F.col(text).cast("string").alias("text")).where("text is not null").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


class CharModel:
    """Interpolated character 4-gram model over a-z and break; prices are -log2 probabilities."""

    def __init__(self, codes: Iterable[int], counts: Iterable[int]):
        import numpy as np

        four = np.zeros(SYMBOLS**ORDER)
        codes = np.asarray(list(codes), np.int64)
        if codes.size:
            four[codes] = np.asarray(list(counts), float)
        four = four.reshape((SYMBOLS,) * ORDER)
        p = (four.sum((0, 1, 2)) + 1) / (four.sum() + SYMBOLS)
        for axes in ((0, 1), (0,), ()):
            c = four.sum(axes) if axes else four
            p = (c + 8 * p) / (c.sum(-1, keepdims=True) + 8)
        self.price = (-np.log2(p)).astype(np.float32)


#: Channel costs in bits: a look-alike read as a letter, a separator dropped or kept as a word break, a run of
#: three or more shortened to two letters or one, a pair shortened to one.
SWAP, DROP, BREAK, SQUEEZE, THIN = 1.0, 1.0, 2.0, 1.0, 12.0


def readings(token: str) -> list[list[tuple[str, float]]]:
    """The lattice of a token: for every run of a character, the strings it may stand for, and their costs."""
    runs: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        c, n = token[i], j - i
        if c in SEPARATORS:
            runs.append([("", DROP), (" ", BREAK)])
        else:
            options = []
            for letter in READINGS.get(c, c if c.isalpha() else ""):
                cost = SWAP if c in READINGS else 0.0
                if n == 1:
                    options.append((letter, cost))
                else:
                    options.append((letter * 2, cost + (0.0 if n == 2 else SQUEEZE)))
                    options.append((letter, cost + (THIN if n == 2 else SQUEEZE)))
            if c in READINGS and not c.isdigit():
                options.append(("", DROP + SWAP))  # a sign may be noise
            runs.append(options or [("", DROP)])
        i = j
    return runs


def decode(token: str, price) -> str:
    """Viterbi over the lattice: the state is the last three letters, breaks stand before and after. Time is in proportion to the token."""

    def symbol(letter: str) -> int:
        return ord(letter) - 96 if "a" <= letter <= "z" else 0

    settled: list[str] = []
    best: dict[tuple[int, int, int], tuple[float, str]] = {(0, 0, 0): (0.0, "")}
    for step, options in enumerate(readings(token), 1):
        following: dict[tuple[int, int, int], tuple[float, str]] = {}
        for state, (cost, text) in best.items():
            for letters, extra in options:
                at, total = state, cost + extra
                for letter in letters:
                    s = symbol(letter)
                    total += float(price[at[0], at[1], at[2], s])
                    at = (at[1], at[2], s)
                old = following.get(at)
                new = (total, text + letters)
                if old is None or new < old:
                    following[at] = new
        best = following
        if step % SETTLE == 0:
            (_, text), state = min((value, state) for state, value in best.items())
            settled.append(text)
            best = {state: (0.0, "")}
    return "".join(settled) + min((cost + float(price[s[0], s[1], s[2], 0]), text) for s, (cost, text) in best.items())[1]


class Restorer:
    """Words of a restored text. Decodings are remembered up to a bound."""

    def __init__(self, price, remember: int = 50_000):
        self.price, self.known, self.remember = price, {}, remember

    def _decoded(self, token: str) -> str:
        if len(token) > REMEMBERED:
            return decode(token, self.price)
        out = self.known.get(token)
        if out is None:
            if len(self.known) >= self.remember:
                self.known.clear()
            out = self.known[token] = decode(token, self.price)
        return out

    def words(self, text: str) -> set[str]:
        text = text.lower()
        tokens = set(text.split())
        out = {t for t in tokens if t.isalpha()}
        tripled = [c * 3 for c in LETTERS if c * 3 in text]
        if tripled:
            for token in out.copy():
                if any(t in token for t in tripled):
                    out.update(self._decoded(token).split())
        for token in tokens.difference(out):
            bare = token.strip(EDGES)
            if bare.isalpha():
                out.add(bare)
                odd = bool(tripled) and REPEATED.search(bare)
            else:
                out.update(part for part in PARTS.split(bare) if part.isalpha())
                odd = True
            odd = odd or token[0] in READINGS or token[-1] in SIGNS
            if odd and any(c.isalpha() for c in token):
                out.update(self._decoded(token.strip(QUOTES)).split())
                out.update(self._decoded(bare).split())
        if sum(len(t) == 1 for t in tokens) > 1:
            for m in SPACED.finditer(text):
                out.update(self._decoded(m.group()).split())
        return out


def features(words: set[str]) -> set[str]:
    """What the model may weigh: words, word beginnings (``^abcd``), and beginnings of two or more words (``^abcd+``)."""
    out = set(words)
    for n in BEGINNINGS:
        once: set[str] = set()
        twice: set[str] = set()
        for w in words:
            if len(w) >= n:
                head = w[:n]
                (twice if head in once else once).add(head)
        out.update(f"^{h}" for h in once)
        out.update(f"^{h}+" for h in twice)
    return out


def _training_words(rows: DataFrame, price) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        restorer = Restorer(price.value)
        for batch in small(batches):
            words = [sorted(features(restorer.words(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["toxic", "words"])

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, words array<string>")


def _word_counts(words: DataFrame) -> DataFrame:
    """(w, a, m): rows and toxic rows with each word, counted in the task before they are shuffled."""

    def run(batches):
        import pyarrow as pa

        seen, bad = Counter(), Counter()
        for batch in small(batches):
            for toxic, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update(ws)
                if toxic:
                    bad.update(ws)
        names = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([bad[w] for w in names], pa.int64()), pa.array([seen[w] for w in names], pa.int64())], ["w", "a", "m"])

    return words.mapInArrow(run, "w string, a long, m long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("m").alias("m"))


def train(docs: DataFrame, labels: DataFrame, price, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, text: str = "text") -> tuple[dict[str, tuple[float, float]], float]:
    """({feature: (weight, lower bound of its toxic share)}, intercept) of the logistic model. `labels`: (doc_id, toxic) of the rows it may learn from."""
    import numpy as np

    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    usable = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumnRenamed("doc_id", "labelled")  # by hash, of bounded size
    body = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = body.join(F.broadcast(sample), F.col("id") == F.col("labelled"))
    words = scratch.write(_training_words(rows, price))
    counted = {r["toxic"]: r["count"] for r in words.groupBy("toxic").count().collect()}
    pos, neg = counted.get(1, 0), counted.get(0, 0)
    prior = (pos + 0.5) / (pos + neg + 1)
    base = float(np.log(prior / (1 - prior)))
    if not pos or not neg:
        return {}, base
    a, m, total = F.col("a").cast("double"), F.col("m").cast("double"), float(pos + neg)
    chi2 = (a * total - m * pos) * (a * total - m * pos) / (m * (total - m + 0.5) * float(pos) * float(neg))
    top = _word_counts(words).where("m >= 5").select("w", "a", "m", chi2.alias("chi2")).orderBy(F.desc("chi2"), "w").limit(max_features).collect()
    index_of = {r["w"]: i for i, r in enumerate(top)}
    names = spark.sparkContext.broadcast(index_of)

    def index(batches):
        import pyarrow as pa

        for batch in small(batches):
            ids = [sorted(names.value[w] for w in ws if w in names.value) for ws in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["toxic", "ids"])

    hits = words.mapInArrow(index, "toxic int, ids array<int>").groupBy("toxic", "ids").count().collect()  # at most max_rows rows
    scratch.drop(words)
    if not index_of:
        return {}, base
    weights, intercept = fit(sorted((r["toxic"], tuple(r["ids"]), r["count"]) for r in hits), len(index_of))
    return {r["w"]: (float(weights[i]), wilson(r["a"], r["m"])) for i, r in enumerate(top)}, intercept


def wilson(hits: int, n: int, z: float = WILSON) -> float:
    """Lower bound of a share; 0 for a share below PURE."""
    p = hits / n
    if p < PURE:
        return 0.0
    return max(0.0, (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n))


def fit(rows: list[tuple[int, tuple[int, ...], int]], width: int, l2: float = 1.0, steps: int = 25):
    """L2 logistic regression on binary rows with multiplicities, by damped Newton steps. `width` is bounded by MAX_FEATURES."""
    import numpy as np

    y = np.array([r[0] for r in rows], float)
    k = np.array([r[2] for r in rows], float)
    x = np.zeros((len(rows), width + 1), np.float32)
    x[:, width] = 1
    for i, r in enumerate(rows):
        x[i, list(r[1])] = 1
    ridge = np.full(width + 1, l2)
    ridge[width] = 1e-6
    w = np.zeros(width + 1)
    w[width] = np.log((k @ y + 0.5) / (k @ (1 - y) + 0.5))

    def loss(v):
        z = x @ v
        return float(k @ (np.logaddexp(0, z) - y * z) + 0.5 * (ridge * v) @ v)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (k * (p - y)) + ridge * w
        h = (x * (k * p * (1 - p))[:, None]).T.astype(float) @ x + np.diag(ridge)
        step, size = np.linalg.solve(h, g), 1.0
        while (then := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        if now - then < 1e-6 * abs(now):
            break
        w, now = w - size * step, then
    return w[:width], float(w[width])


class Model:
    """What a task needs to score: prices of the language model, feature weights and bounds, intercept."""

    def __init__(self, price, weights: dict[str, tuple[float, float]], intercept: float):
        self.price, self.weights, self.intercept = price, weights, intercept
        self.words = {w for w in weights if w[0] != "^"}
        self.heads = {n: {w[1:].rstrip("+") for w in weights if w[0] == "^" and len(w.rstrip("+")) == n + 1} for n in BEGINNINGS}

    def probability(self, words: set[str]) -> float:
        import math

        found = sorted(words & self.words)
        for n, heads in self.heads.items():
            if heads:
                seen = Counter(h for w in words if (h := w[:n]) in heads)
                found += [f"^{h}" for h in seen] + [f"^{h}+" for h, k in seen.items() if k > 1]
        pairs = [self.weights[f] for f in sorted(found) if f in self.weights]
        z = max(-30.0, min(30.0, self.intercept + sum(w for w, _ in pairs)))
        return max([1 / (1 + math.exp(-z)), *(low for _, low in pairs)])


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """The language model from all of `docs`, the word weights from `labels` (doc_id, toxic)."""
    grams = count_ngrams(docs, text).collect()  # at most 27^4 rows
    price = CharModel([r["code"] for r in grams], [r["n"] for r in grams]).price
    shared = docs.sparkSession.sparkContext.broadcast(price)
    weights, intercept = train(docs, labels, shared, max_rows, max_features, text)
    return Model(price, weights, intercept)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with a toxicity score in 0..1."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]
    schema = StructType([*(docs.schema[c] for c in kept), StructField(name, DoubleType())])
    at = kept.index(text)

    def run(batches):
        import pyarrow as pa

        model_ = shared.value
        restorer = Restorer(model_.price)
        for batch in small(batches):
            scores = [model_.probability(restorer.words(body or "")) for body in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*kept, name])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def held_out():
    """crc32 of doc_id as text, modulo 4, is 2: rows that are never learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def production_model(spark, sf_dir: str, docs: DataFrame) -> Model:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    return learn(docs, labels)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, production_model(spark, sf_dir, docs))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
