"""Dense retrieval: embedding tables and exact top-k by cosine, in blocks of questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.functions import text as X
from ledgerloom.functions import vectors as V
from ledgerloom.operators.best import Best, in_few_tasks

#: Questions whose vectors go to the tasks at once (64 doubles each); similarities that are computed at once; rows that
#: a task keeps of groups, before it gives them and begins anew.
BLOCK, AT_ONCE, MOST_KEPT = 4096, 4_000_000, 2_000_000


def hashed_embeddings(texts: DataFrame, key: str, *keep: str, dim: int = V.DIM, tokens=X.tokens) -> DataFrame:
    """key, the columns to keep, embedding: unit vectors of hashed token counts; a stand-in for a model that any host has.

    texts(key, body).  Texts without tokens have no vector.
    """
    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots: dict[str, int] = {}
        for pdf in batches:
            vectors = []
            for words in pdf["words"]:
                for w in words:
                    if w not in slots:
                        slots[w] = V.slot_of(w, dim)
                counts = np.bincount([slots[w] for w in words], minlength=dim)
                vectors.append(counts / np.sqrt((counts * counts).sum()))
            yield pdf.drop(columns="words").assign(embedding=vectors)

    types = dict(texts.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (key, *keep)) + ", embedding array<double>"
    return texts.select(key, *keep, tokens(F.col("body")).alias("words")).filter(F.size("words") > 0).mapInPandas(embed, schema)


def counted_vectors(counted: DataFrame) -> DataFrame:
    """key, company, embedding from counted(chunk_id, company, slots, norm), written: the unit vectors of hashed_embeddings."""
    # the norm is a stored column, as an expression would be computed anew for every element
    return counted.filter("norm > 0").select(F.col("chunk_id").alias("key"), "company", F.transform(V.doubles(F.col("slots")), lambda x: x / F.col("norm")).alias("embedding"))


def _blocks(rows: Iterator, size: int) -> Iterator[list]:
    block = []
    for r in rows:
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def cosine_topk(vectors: DataFrame, questions: DataFrame, k: int, group: str | None = None, block: int = BLOCK) -> DataFrame:
    """qid, key, [group,] sim, rank: the k most similar rows of each question (of each group if one is named).

    vectors(key, embedding[, group]), questions(qid, embedding); unit vectors.  Each task multiplies
    its rows with a block of questions and keeps its own best, so that only candidates are
    shuffled.  Similarities are rounded to six places before ranking; ties go to the least key.
    """
    kind, qkind = dict(vectors.dtypes)["key"], dict(questions.dtypes)["qid"]
    schema = f"qid {qkind}, key {kind}" + (f", {group} {dict(vectors.dtypes)[group]}" if group else "") + ", sim double"
    qtype = to_arrow_type(questions.schema["qid"].dataType)
    source = in_few_tasks(vectors.select("key", "embedding", *([group] if group else [])).filter("embedding is not null"))
    spark, parts = vectors.sparkSession, []
    rows = questions.select("qid", "embedding").filter("embedding is not null").orderBy("qid").toLocalIterator()
    for rows_ in _blocks(rows, block):
        shared = spark.sparkContext.broadcast(([r["qid"] for r in rows_], np.array([r["embedding"] for r in rows_], dtype=np.float64)))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, matrix = shared.value
            asked, step = np.array(qids, dtype=object), max(64, AT_ONCE // len(qids))
            top, groups, types = Best(k, 0 if group else len(qids)), {}, {}

            def found() -> Iterator[pa.RecordBatch]:
                rows, sims, keys = top.result()
                names = np.array(list(groups), dtype=object)
                for at in range(0, len(rows), 20_000):
                    some = slice(at, at + 20_000)
                    out = {"qid": pa.array(asked[rows[some] % len(qids)], qtype), "key": pa.array(keys[some], types["key"])}
                    if group:
                        out[group] = pa.array(names[rows[some] // len(qids)], types[group])
                    yield pa.RecordBatch.from_pydict(out | {"sim": pa.array(sims[some])})

            for batch in batches:
                types = {c: batch.schema.field(c).type for c in batch.schema.names}
                for at in range(0, len(batch), step):
                    part = batch.slice(at, step)
                    embedded = part.column("embedding")
                    sims = matrix @ embedded.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1).T
                    keys = np.array(part.column("key").to_pylist(), dtype=object)
                    if not group:
                        top.add(sims, keys)
                        continue
                    members: dict[object, list[int]] = {}
                    for i, name in enumerate(part.column(group).to_pylist()):
                        members.setdefault(name, []).append(i)
                    for name, mine in members.items():
                        if name not in groups:
                            groups[name] = len(groups)
                            top.grow(len(qids))
                        top.add(sims[:, mine], keys[mine], groups[name] * len(qids))
                    if len(groups) * len(qids) * k > MOST_KEPT:
                        yield from found()
                        top, groups = Best(k), {}
            yield from found()

        parts.append(source.mapInArrow(best, schema))
    if not parts:
        return spark.createDataFrame([], schema + ", rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    within = Window.partitionBy("qid", *([group] if group else [])).orderBy(F.desc("sim"), "key")
    return found.withColumn("rank", (F.row_number().over(within) - 1).cast("int")).filter(F.col("rank") < k)
