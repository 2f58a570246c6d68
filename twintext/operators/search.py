"""Concordance, document frequencies and exact vector search."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twintext.functions import text as T

#: Longest phrase that is searched.
MAX_CHARS, MAX_WORDS = 120, 12


def concordance(rows: DataFrame, phrase: str, key: list[str], text_col: str = "line", limit: int = 50) -> DataFrame:
    """Segments that hold the phrase as whole words, marks and case apart; newest key first.

    ``rank`` runs to ``limit``; ``more`` tells whether further ones exist.
    """
    if len(phrase) > MAX_CHARS or not 0 < len(phrase.split()) <= MAX_WORDS:
        raise ValueError("a phrase has 1 to 12 words and 120 characters at most")
    wanted = T.concordance_text(F.lit(phrase))
    # A phrase of plain letters can only lie in texts that hold its first word or letters beyond ASCII.
    first = re.match(r"[a-z0-9]+", phrase.lower())
    near = F.contains(F.lower(text_col), F.lit(first[0])) | F.col(text_col).rlike("[^\\x{0}-\\x{7f}]") if first else F.lit(True)
    hits = rows.where(near).where(F.contains(T.concordance_text(F.col(text_col)), wanted)).select(*key)
    # limit + 1 rows reach one task, not all hits.
    top = hits.orderBy(*[F.col(k).desc() for k in key]).limit(limit + 1)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*[F.col(k).desc() for k in key])))
    return ranked.withColumn("more", F.max("rank").over(Window.partitionBy()) > limit).where(F.col("rank") <= limit)


def concordance_pairs(variants: DataFrame, phrase: str, searched: str, other: str, limit: int = 50) -> DataFrame:
    """Units whose text in one language holds the phrase, with the best counterpart in the other.

    ``variants`` has priority (of the memory), tu_id, tuv_id, lang, plain,
    quality, updated_at and deleted. Memories come in order of priority and
    share one limit; in each the newest variant comes first. The counterpart
    is the one of highest quality, then latest change, then least tuv_id;
    units without one are left out. Languages meet by primary subtag.
    """
    if len(phrase) > MAX_CHARS or not 0 < len(phrase.split()) <= MAX_WORDS:
        raise ValueError("a phrase has 1 to 12 words and 120 characters at most")
    live = variants.where("not deleted").withColumn("__primary", T.primary_subtag(F.col("lang")))
    primary = lambda lang: lang.lower().replace("_", "-").split("-")[0]
    folded = T.concordance_text(F.col("plain"))
    # A phrase of plain letters can only lie in texts that hold its first word or letters beyond ASCII.
    first = re.match(r"[a-z0-9]+", phrase.lower())
    near = F.contains(F.lower("plain"), F.lit(first[0])) | F.col("plain").rlike("[^\\x{0}-\\x{7f}]") if first else F.lit(True)
    hits = live.where((F.col("__primary") == primary(searched)) & near).where(F.contains(folded, T.concordance_text(F.lit(phrase))))
    best = F.max_by(F.struct(F.col("tuv_id").alias("other_id"), F.col("plain").alias("other"), F.col("quality").alias("other_quality")), F.struct("quality", "updated_at", (-F.col("tuv_id")).alias("id")))
    counterparts = live.where(F.col("__primary") == primary(other)).join(hits.select("priority", "tu_id").distinct(), ["priority", "tu_id"], "left_semi").groupBy("priority", "tu_id").agg(best.alias("x"))
    order = [F.col("priority"), F.col("tuv_id").desc()]
    found = hits.join(counterparts, ["priority", "tu_id"]).select("priority", "tu_id", "tuv_id", "plain", "x.*")
    top = found.orderBy(*order).limit(limit + 1)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.withColumn("more", F.max("rank").over(Window.partitionBy()) > limit).where(F.col("rank") <= limit)


def ranges_in(text: str, phrase: str) -> list[tuple[int, int]]:
    """Code-point ranges (end exclusive) of the phrase's whole-word occurrences, none overlapping."""
    plain = lambda w: "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.category(c).startswith("M")).lower()
    # Combining marks belong to the word before them.
    spans = [(m.start(), m.end(), plain(m[0])) for m in re.finditer(r"(?:[^\W_]|[\u0300-\u036f])+", text)]
    wanted, out, i = [plain(w) for w in phrase.split()], [], 0
    while wanted and i + len(wanted) <= len(spans):
        if [w for *_, w in spans[i : i + len(wanted)]] == wanted:
            out.append((spans[i][0], spans[i + len(wanted) - 1][1]))
            i += len(wanted)
        else:
            i += 1
    return out


def highlight_ranges(text: Column, phrase: str) -> Column:
    """``ranges_in`` as a column of (start, end); only texts that hold the phrase go to Python."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def ranges(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [{"start": a, "end": b} for a, b in ranges_in(t, phrase)])

    return ranges(F.when(F.contains(T.concordance_text(text), T.concordance_text(F.lit(phrase))), text))


def document_frequency(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """How many texts hold each folded word."""
    words = F.split(F.trim(T.concordance_text(F.col(text_col))), " ")
    return rows.select(F.explode(F.array_distinct(words)).alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("docs"))


#: Bytes of vectors of a block, as they meet another one.
BLOCK_BYTES = 8 << 20


def _dealt(rows: DataFrame, id_col: str, vector_col: str, name: str) -> tuple[DataFrame, int]:
    """The vectors dealt to blocks of bounded size, and how many there are."""
    rows = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    size = rows.agg(F.max(F.size("vector")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    blocks = max(1, -(-(size["n"] or 0) * (size["d"] or 1) * 8 // BLOCK_BYTES))
    return rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), blocks


def top_by_dot(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` largest dot products for each query, exactly; a query isn't its own hit, of equal ones the least id comes first.

    Queries are a stated set, held against all rows: both are dealt to blocks
    of bounded size, and every two blocks meet in a task of their own, which
    keeps the ``k`` best of its rows for each query. Nothing passes the driver.
    Rows without a vector are left out.
    """
    kind = dict(vectors.dtypes)[id_col]
    v, v_blocks = _dealt(vectors, id_col, vector_col, "v")
    q, q_blocks = _dealt(queries, id_col, vector_col, "q")
    v = v.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    q = q.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))

    def product(asked: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query_id", id_col, "dot"]
        if not len(asked) or not len(rows):
            return pa.table([pa.array([], asked["id"].type), pa.array([], rows["id"].type), pa.array([], pa.float64())], names=names)
        rows = rows.sort_by("id")
        matrix = lambda t: t["vector"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        left, right = matrix(asked), matrix(rows)
        # A product of matrices rounds by place; what may be among the best is summed anew, so that equal vectors tie.
        slack = 1e-9 * np.sqrt((left * left).sum(axis=1)) * np.sqrt((right * right).sum(axis=1).max())
        ids, own = asked["id"].to_pylist(), rows["id"].to_pylist()
        places: dict = {}
        for n, i in enumerate(own):
            places.setdefault(i, []).append(n)
        of, at = [], []
        found = []
        # Products of so many queries at a time that they stay within ``BLOCK_BYTES``.
        step = max(1, BLOCK_BYTES // (8 * len(own)))
        for n in range(len(ids)):
            if n % step == 0:
                dots = left[n : n + step] @ right.T
            row = dots[n % step]
            row[places.get(ids[n], [])] = -np.inf
            least = np.partition(row, -min(k, len(row)))[-min(k, len(row))]
            near = np.flatnonzero((row >= least - slack[n]) & np.isfinite(row))
            exact = np.cumsum(left[n] * right[near], axis=1)[:, -1]
            first = np.argsort(-exact, kind="stable")[:k]
            best = near[first]
            of.append(np.full(len(best), n))
            at.append(best)
            found.append(exact[first])
        of, at = np.concatenate(of), np.concatenate(at)
        return pa.table([asked["id"].take(pa.array(of)), rows["id"].take(pa.array(at)), pa.array(np.concatenate(found))], names=names)

    found = q.groupBy("q", "v").cogroup(v.groupBy("q", "v")).applyInArrow(product, f"query_id {kind}, {id_col} {kind}, dot double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("dot").desc(), id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def without_vector(variants: DataFrame, vectors: DataFrame, on: list[str]) -> DataFrame:
    """Variants that no vector belongs to."""
    return variants.join(vectors, on, "left_anti")
