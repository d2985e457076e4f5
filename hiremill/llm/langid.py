"""Language identification by nearest centroid.

A text is a TF-IDF vector of its letter n-grams (one to three code points, case folded, words apart), hashed to a fixed number of
cells and scaled to unit length. Every language has several centroids, found by spherical k-means over a bounded sample of its
labelled texts; a text gets the language of the nearest centroid by cosine. Each centroid keeps the distance that nearly all of its
members have; a text much farther away is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiremill.llm.arrays import code_points, mixed, text_chunks
from hiremill.llm.shared import ship_package

#: Cells of a vector, labelled texts per language that fit the centroids at most, centroids per language, rounds of k-means.
CELLS, SAMPLE_PER_LANGUAGE, CENTROIDS, ROUNDS = 8192, 800, 4, 12
#: A centroid's radius is this quantile of its members' distances times the slack.
RADIUS_QUANTILE, RADIUS_SLACK = 0.995, 1.25
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Folded letter of each code point, 0 for all that is no letter."""
    if not _LETTERS:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _LETTERS.append(table)
    return _LETTERS[0]


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (row * CELLS + cell), how often each occurs, and the letters of each row."""
    rows = len(offsets) - 1
    letters = _letters()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")]
    row = np.repeat(np.arange(rows), code_points(data, offsets))
    n_letters = np.bincount(row[letters > 0], minlength=rows)
    values = letters.astype(np.uint64)
    cells = []
    for size in (1, 2, 3):
        n = len(values) - size + 1
        if n <= 0:
            break
        # Letters and gaps alternate in a key; runs of gaps and n-grams across rows are left out.
        key, ok = np.full(n, np.uint64(size)), row[:n] == row[size - 1:]
        some = np.zeros(n, bool)
        for k in range(size):
            part = values[k:k + n]
            key = key * np.uint64(0x110001) + part
            some |= part > 0
            if k:
                ok = ok & ~((part == 0) & (values[k - 1:k - 1 + n] == 0))
        ok &= some
        cells.append(row[:n][ok] * CELLS + (mixed(key[ok]) % np.uint64(CELLS)).astype(np.int64))
    cell, n = np.unique(np.concatenate(cells) if cells else np.zeros(0, np.int64), return_counts=True)
    return cell, n, n_letters


def _vectors(cell: np.ndarray, n: np.ndarray, rows: int, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF weights of the cells."""
    weight = (1 + np.log(n)) * idf[cell % CELLS]
    norm = np.sqrt(np.bincount(cell // CELLS, weights=weight**2, minlength=rows))
    return weight / np.maximum(norm[cell // CELLS], 1e-12)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language_of: np.ndarray
    radius: np.ndarray


def held_out(key: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; the first centres are the first vector and, in turn, the one farthest from all centres."""
    centres = [x[0]]
    for _ in range(1, min(k, len(x))):
        centres.append(x[np.argmin(np.max(x @ np.stack(centres).T, axis=1))])
    c = np.stack(centres)
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].sum(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """Centroids from at most `per_language` texts of each language, those with the smallest hash; None where nothing can be learned."""
    ship_package(docs.sparkSession)
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    marked = docs.where(learn & F.col(lang).isNotNull() & (F.col(text) != "")).select(F.col(lang).alias("language"), mark.alias("mark"), F.col(text).alias("body"))
    # A share of the hashes that surely holds the smallest ones leaves few rows of any language to be ranked.
    sizes = marked.groupBy("language").agg(F.approx_count_distinct("mark").alias("n")).collect()
    if not sizes:
        return None
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["language"]), F.lit(int(-2**63 + min(1.0, 4.0 * per_language / max(r["n"], 1)) * (2**64 - 2**11))))])
    near = marked.where(F.col("mark") <= F.try_element_at(share, F.col("language")))
    ranked = near.select("language", "mark").distinct().select(
        "language", "mark", F.row_number().over(Window.partitionBy("language").orderBy("mark")).alias("rank"))
    cuts = ranked.where(F.col("rank") <= per_language).groupBy("language").agg(F.max("mark").alias("cut")).collect()
    if not cuts:
        return None
    # One bounded row per language, so the comparison is a small map in the filter and no join.
    bounds = F.create_map(*[x for r in cuts for x in (F.lit(r["language"]), F.lit(r["cut"]))])
    sample = marked.where(F.col("mark") <= F.try_element_at(bounds, F.col("language"))).dropDuplicates(["language", "mark"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, counts = [], []
            for _, end, data, offsets in text_chunks(batch.column(2)):
                cell, n, _ = term_counts(data, offsets)
                cut = np.searchsorted(cell, np.arange(len(offsets)) * CELLS)
                for i in range(len(offsets) - 1):
                    part = slice(cut[i], cut[i + 1])
                    cells.append((cell[part] % CELLS).astype("<u2").tobytes())
                    counts.append(np.minimum(n[part], 2**31 - 1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary()), pa.array(counts, pa.binary())], names=["language", "cells", "counts"])

    terms = sample.mapInArrow(count, "language string, cells binary, counts binary").where(F.length("cells") > 0).persist()
    total = terms.count()
    if not total:
        return None

    def document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(CELLS, np.int64)
        for batch in batches:
            for cells in batch.column(0).to_pylist():
                df[np.frombuffer(cells, "<u2")] += 1
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary())], names=["df"])

    parts = terms.select("cells").coalesce(8).mapInArrow(document_frequency, "df binary").collect()
    idf = np.log((1 + total) / (1 + sum(np.frombuffer(bytes(r["df"]), np.int64) for r in parts))) + 1

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["cells", "counts"])
        x = np.zeros((len(frame), CELLS), np.float32)
        for i, (cells, counts) in enumerate(zip(frame["cells"], frame["counts"])):
            cell, n = np.frombuffer(cells, "<u2").astype(np.int64), np.frombuffer(counts, "<i4")
            x[i, cell] = _vectors(cell, n, 1, idf)
        centres = _kmeans(x, CENTROIDS)
        cosine = x @ centres.T
        near = np.argmax(cosine, axis=1)
        distance = 1 - cosine.max(1)
        everywhere = np.quantile(distance, RADIUS_QUANTILE)
        radius = [RADIUS_SLACK * (np.quantile(distance[near == j], RADIUS_QUANTILE) if (near == j).sum() >= 20 else everywhere) for j in range(len(centres))]
        return pd.DataFrame({"language": frame["language"].iloc[0], "centre": [c.astype("<f4").tobytes() for c in centres], "radius": radius})

    rows = sorted(terms.groupBy("language").applyInPandas(cluster, "language string, centre binary, radius double").collect(), key=lambda r: (r["language"], bytes(r["centre"])))
    terms.unpersist()
    names = sorted({r["language"] for r in rows})
    return LanguageModel(
        names, idf, np.stack([np.frombuffer(bytes(r["centre"]), "<f4") for r in rows]).astype(np.float32),
        np.asarray([names.index(r["language"]) for r in rows]), np.asarray([r["radius"] for r in rows]))


def predict(docs: DataFrame, model: LanguageModel | None, keep: list[str], text: str = "text") -> DataFrame:
    """Adds lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected to the columns `keep`.

    A text that is null or has no letter is `und` with score 0 and rejected; so is every text where no model could be learned. Among
    equal cosines the first language by name wins. Rows, repeated or not, stay as they are.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col(text).alias("__body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores, rejected = [], [], []
            for _, end, data, offsets in text_chunks(batch.column(batch.num_columns - 1)):
                rows = len(offsets) - 1
                cell, n, letters = term_counts(data, offsets)
                if model is None:
                    letters = np.zeros(rows, np.int64)
                    near, best = np.zeros(rows, np.int64), np.zeros(rows)
                else:
                    weight = _vectors(cell, n, rows, model.idf)
                    cosine = np.stack([np.bincount(cell // CELLS, weights=weight * c[cell % CELLS], minlength=rows) for c in model.centroids], axis=1)
                    near = np.argmax(cosine, axis=1)
                    best = np.clip(cosine[np.arange(rows), near], 0, 1)
                for i in range(rows):
                    known = letters[i] > 0
                    names.append(model.languages[model.language_of[near[i]]] if known else UNKNOWN)
                    scores.append(float(best[i]) if known else 0.0)
                    rejected.append(not known or bool(1 - best[i] > model.radius[near[i]]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{own}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score, rejected): learned from the labelled texts that are not held out, predicted for all."""
    model = fit(docs, ~held_out(key), text, lang)
    return predict(docs.select(key, text, held_out(key).alias("held_out")), model, [key, "held_out"], text)
