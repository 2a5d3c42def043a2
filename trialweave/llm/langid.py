"""Language ID by nearest clustered centroid of TF-IDF n-gram vectors."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.functions.ship import map_arrow
from trialweave.llm.common import small_batches

#: Hashed n-gram dimensions; centroids per language; rounds of clustering.
DIMENSIONS, CENTROIDS, ROUNDS = 4096, 4, 8
#: Vectors of one language that the driver holds at most: its centroids.  All rows are learned from.
SAMPLE = CENTROIDS
#: Vectors are added as multiples of this, so that sums do not depend on their order.
GRAIN = 2.0**-30
#: A text is rejected below this share of the least similarity that a learned text of its length, or shorter, has to
#: its centroid.  Lengths go by powers of two of the n-grams; ``LENGTHS`` of them.
REJECT, LENGTHS = 0.6, 32
#: Learned texts and beginnings that a length class needs for a threshold of its own.
ENOUGH = 100

#: Bytes of a text that are counted at a time.
BLOCK = 1 << 20
#: What a slice of rows may need while it is counted: dense counts for each row, indices for each byte.
NEED = {"limit": 16 << 20, "per_row": 16 * DIMENSIONS, "per_byte": 32}

#: Lower-case bytes with all ASCII but letters as space.
_PLAIN = bytes(b | 32 if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def counts(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed byte 2- and 3-grams of the lower-cased texts, a row for each text."""
    raw = [b" " + (t or "").lower().encode("utf-8").translate(_PLAIN) + b"  " for t in texts]
    out = _counts([x if len(x) <= BLOCK else b"   " for x in raw])
    for i, x in enumerate(raw):
        if len(x) > BLOCK:
            for k in range(0, len(x) - 2, BLOCK):
                out[i] += _counts([x[k:k + BLOCK + 2]])[0]
    return out


def _counts(raw: list[bytes]) -> np.ndarray:
    """Each n-gram starts before its row's last two bytes; rows of several end in two blanks."""
    sizes = np.array([len(x) for x in raw], np.int64)
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(raw)), sizes)[:-2] * DIMENSIONS
    two = b[:-2] << np.uint32(8) | b[1:-1]
    apart = two != 0x2020  # no n-gram starts with two blanks, so none reaches into the next text
    two, three, row = two[apart], b[2:][apart], row[apart]
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    out = np.zeros(len(raw) * DIMENSIONS, np.float32)
    for grams in (two * np.uint32(2654435761), ((two << np.uint32(8) | three) + np.uint32(1)) * np.uint32(2246822519)):
        out += np.bincount(row + (grams >> shift), minlength=len(out))
    return out.reshape(len(raw), DIMENSIONS)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """``centroids`` are rows of unit length, and ``langs`` go with them; ``least`` is the least accepted similarity by length."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: np.ndarray

    def alike(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Each text's similarity to each centroid, and its length class."""
        x = counts(texts)
        return unit(np.log1p(x) * self.idf) @ self.centroids.T, np.minimum(np.log2(np.maximum(x.sum(axis=1), 1)).astype(np.int64), LENGTHS - 1)

    def judge(self, texts) -> list[tuple[str, float, bool]]:
        """(language, similarity from 0 to 1, accepted) of each text; ``und`` without a letter or a model."""
        out = []
        alike, length = self.alike(texts) if len(self.langs) else (None, None)
        for i, text in enumerate(texts):
            if alike is None or not has_letter(text):
                out.append(("und", 0.0, False))
                continue
            k = int(np.round(alike[i], 6).argmax())
            score = round(min(1.0, max(0.0, float(alike[i, k]))), 4)
            out.append((self.langs[k], score, bool(score >= self.least[length[i]])))
        return out


def cluster(sums: np.ndarray) -> np.ndarray:
    """Unit centroids of a language from the sum of each one's rows."""
    return unit(sums.astype(np.float64)).astype(np.float32)


def held_out(id_col: Column) -> Column:
    """Whether the crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows with a language that :func:`held_out` does not hold out.

    All these rows count in every step: in document frequencies and rows per language, in
    the spherical k-means of each language (its mean row, then the row farthest from the
    centroids so far, then ``ROUNDS`` rounds of means, fewer if nothing moves any more), and
    in the rejection's thresholds.  A step is one pass over the rows; a task hands on
    ``DIMENSIONS`` sums a centroid, and the driver gets as many, or one row per language.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def frequencies(batches):
        import pyarrow as pa

        df, langs = np.zeros(DIMENSIONS, np.int64), Counter()
        for batch in small_batches(batches, 0, **NEED):
            df += (counts(batch.column(0).to_pylist()) > 0).sum(axis=0)
            langs.update(batch.column(1).to_pylist())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*some.tolist(), *[-1] * len(langs)], pa.int32()), pa.array([*[None] * len(some), *langs], pa.string()), pa.array([*df[some].tolist(), *langs.values()], pa.int64())],
            ["k", "lang", "n"])

    sums = map_arrow(rows.select("text", "lang"), frequencies, "k int, lang string, n long").groupBy("k", "lang").agg(F.sum("n").alias("n")).collect()
    df, sizes = np.zeros(DIMENSIONS), {}
    for r in sums:
        if r["k"] < 0:
            sizes[r["lang"]] = r["n"]
        else:
            df[r["k"]] = r["n"]
    total = sum(sizes.values())
    idf = (np.log((1 + total) / (1 + df)) + 0.05).astype(np.float32)

    names = sorted(sizes)
    if not names:
        return Model(idf, np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(0))

    mean, number = _added(rows, idf, names, None)
    centers = [cluster(mean[g, :1]) for g in range(len(names))]
    for k in range(1, CENTROIDS):
        far = _farthest(rows, idf, names, centers)
        centers = [np.vstack([c, far[g]]) if number[g].sum() > k else c for g, c in enumerate(centers)]
    for _ in range(ROUNDS):
        sums, number = _added(rows, idf, names, centers)
        moved = [np.where(number[g, :len(c), None] > 0, cluster(sums[g, :len(c)]), c) for g, c in enumerate(centers)]
        if all(map(np.array_equal, moved, centers)):
            break
        centers = moved
    else:
        number = _added(rows, idf, names, centers, sums=False)[1]
    held = [(c, lang) for g, lang in enumerate(names) for c, n in zip(centers[g], number[g]) if n]
    model = Model(idf, np.array([c for c, _ in held], np.float32).reshape(-1, DIMENSIONS), [lang for _, lang in held], np.zeros(LENGTHS))
    if held:
        model.least = thresholds(rows, model)
    return model


def _vectors(batches, idf: np.ndarray, names: list[str]):
    """Unit vectors of (lang, text) rows that have an n-gram, a slice and a language at a time."""
    place = {lang: g for g, lang in enumerate(names)}
    for batch in small_batches(batches, 1, **NEED):
        x = unit(np.log1p(counts(batch.column(1).to_pylist())) * idf)
        own, some = np.array([place[lang] for lang in batch.column(0).to_pylist()]), x.any(axis=1)
        for g in np.unique(own[some]).tolist():
            yield g, x[some & (own == g)]


def _added(rows: DataFrame, idf: np.ndarray, names: list[str], centers: list[np.ndarray] | None, sums: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """By language and nearest of its centroids (the first, without any): the sum of the rows' vectors, and their number."""

    def run(batches):
        import pyarrow as pa

        total, number = {}, Counter()
        for g, x in _vectors(batches, idf, names):
            at = np.zeros(len(x), int) if centers is None else np.round(x @ centers[g].T, 6).argmax(axis=1)
            for k in np.unique(at).tolist():
                slot, own = g * CENTROIDS + k, x[at == k]
                number[slot] += len(own)
                if sums:
                    total[slot] = total.get(slot, 0) + np.rint(own * np.float32(1 / GRAIN)).sum(axis=0, dtype=np.float64).astype(np.int64)
        for slot, n in number.items():
            v = total.get(slot, np.zeros(0, np.int64))
            some = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([*(slot * DIMENSIONS + some).tolist(), -1 - slot], pa.int64()), pa.array([*v[some].tolist(), n], pa.int64())], ["k", "n"])

    found = map_arrow(rows.select("lang", "text"), run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = (found.column(c).to_numpy() for c in ("k", "n"))
    total, number = np.zeros(len(names) * CENTROIDS * DIMENSIONS), np.zeros(len(names) * CENTROIDS, np.int64)
    total[k[k >= 0]] = n[k >= 0] * GRAIN
    number[-1 - k[k < 0]] = n[k < 0]
    return total.reshape(len(names), CENTROIDS, DIMENSIONS), number.reshape(len(names), CENTROIDS)


def _farthest(rows: DataFrame, idf: np.ndarray, names: list[str], centers: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Each language's row least like its nearest centroid; of equally far ones, the least vector by its bytes."""

    def run(batches):
        import pyarrow as pa

        best = {}
        for g, x in _vectors(batches, idf, names):
            near = np.round((x @ centers[g].T).max(axis=1).astype(np.float64), 6)
            if g in best and near.min() > best[g][0]:
                continue
            for v in x[near == near.min()]:
                some = np.flatnonzero(v)
                best[g] = min(best.get(g, (np.inf,)), (near.min(), some.astype("<i4").tobytes(), v[some].astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(best), pa.int32()), *(pa.array([b[i] for b in best.values()], kind) for i, kind in enumerate((pa.float64(), pa.binary(), pa.binary())))], ["g", "s", "k", "v"])

    found = map_arrow(rows.select("lang", "text"), run, "g int, s double, k binary, v binary").groupBy("g").agg(F.min(F.struct("s", "k", "v")).alias("r")).collect()
    out = {}
    for r in found:
        out[r["g"]] = np.zeros((1, DIMENSIONS), np.float32)
        out[r["g"]][0, np.frombuffer(r["r"]["k"], "<i4")] = np.frombuffer(r["r"]["v"], "<f4")
    return out


def thresholds(rows: DataFrame, model: Model) -> np.ndarray:
    """The least accepted similarity by length class, from the least of all learned texts and their beginnings.

    A longer text is held to what shorter ones reach, at least; a class of fewer than
    ``ENOUGH`` texts to what the next shorter one is, or to half of the least similarity of all.
    """

    def run(batches):
        import pyarrow as pa

        least, number = {}, Counter()
        for batch in small_batches(batches, 0, **{**NEED, "per_row": 8 * NEED["per_row"]}):
            parts = []
            for text in batch.column(0).to_pylist():
                parts += [(text or "")[:n] for n in (16, 32, 64, 128, 256, 512, 1024) if n < len(text or "")] + [text]
            parts = [x for x in parts if has_letter(x)]
            if parts:
                alike, length = model.alike(parts)
                for k, v in zip(length.tolist(), np.round(alike.max(axis=1).astype(np.float64), 6).tolist()):
                    least[k] = min(v, least.get(k, 1.0))
                    number[k] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.float64()), pa.array([number[k] for k in least], pa.int64())], ["k", "v", "n"])

    found = map_arrow(rows.select("text"), run, "k int, v double, n long").groupBy("k").agg(F.min("v"), F.sum("n")).collect()
    least = min((v for _, v, _ in found), default=0.0) / 2
    known = {k: v for k, v, n in found if n >= ENOUGH}
    return REJECT * np.maximum.accumulate([known.get(k, least) for k in range(LENGTHS)])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``__lang``, ``__score`` and ``__accepted`` to every row, from the whole text alone."""
    kept = docs.columns
    at = kept.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, at, **NEED):
            found = model.judge(batch.column(at).to_pylist())
            more = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x, kind) for x, kind in zip(more, (pa.string(), pa.float64(), pa.bool_())))],
                [*kept, "__lang", "__score", "__accepted"])

    schema = T.StructType([
        *docs.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType()),
        T.StructField("__accepted", T.BooleanType())])
    return map_arrow(docs, run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The language of every text: ``id_col``, ``held_out``, ``lang_pred``, ``score``, ``rejected``.

    The nearest centroid by cosine names the language, and ``score`` is the cosine, from 0
    to 1.  A null or empty text, or one without a letter, is ``und`` with score 0.  A text
    nearer to no centroid than ``REJECT`` allows at its length is ``rejected``, as all
    ``und`` ones are: the longer a text, the nearer it has to be.
    Without a labelled row everything is ``und``.  Equal texts have equal predictions;
    rows that repeat an id are judged each on its own.  A null id is not learned from and
    not held out.  Other columns are not read.  An empty table gives an empty result.
    """
    model = fit(docs, id_col, text_col, lang_col)
    out = predict(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model, "id", "text")
    return out.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), F.col("__lang").alias("lang_pred"),
        F.col("__score").alias("score"), (~F.col("__accepted")).alias("rejected"))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text is not rejected; all columns stay."""
    model = fit(docs, id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).filter("__accepted").drop("__lang", "__score", "__accepted")
