"""Nested documents: assembly, checks, fingerprints, drawing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, columns: list[str], name: str) -> DataFrame:
    """Parents with an ordered array of their children's columns; parents without children have an empty one."""
    lists = children.groupBy(F.col(child_key).alias("_k")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    joined = parents.join(lists, F.col(parent_key) == F.col("_k"), "left").drop("_k")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(dict(lists.dtypes)[name])))


def violations(docs: DataFrame, ident: str, checks: dict[str, Column]) -> DataFrame:
    """(ident, message): one row for each check that a document fails; a document that passes has none. Checks are true where they are violated."""
    hits = F.filter(F.array(*[F.when(bad, F.lit(message)) for message, bad in checks.items()]), lambda x: x.isNotNull())
    return docs.select(ident, F.explode(hits).alias("message"))


def fingerprint(files: DataFrame, keys: tuple[str, ...], name: Column, size: Column) -> DataFrame:
    """(keys, fingerprint): SHA-1 over name:size of a capture's files in order.

    SHA-1 goes through a capture's files one after the other, so these pass through one task, sorted and in batches: they are never held as a whole.
    """
    parts = files.select(*keys, name.alias("_n"), F.concat(name, F.lit(":"), size.cast("string")).alias("_s"))
    ordered = parts.repartition(*keys).sortWithinPartitions(*keys, "_n", "_s").drop("_n")
    form = parts.select(*keys).schema.add("fingerprint", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest = None, None
        for batch in batches:
            done = []
            names = [batch.schema.field(k) for k in keys]
            for *key, text in zip(*[batch.column(k).to_pylist() for k in (*keys, "_s")], strict=True):
                if digest is None or key != own:
                    if digest is not None:
                        done.append([*own, digest.hexdigest()])
                    own, digest = key, hashlib.sha1()
                digest.update((text or "").encode())
            if done:
                yield _digests(done, names)
        if digest is not None:
            yield _digests([[*own, digest.hexdigest()]], names)

    return ordered.mapInArrow(run, form)


def _digests(rows: list[list], keys: list[pa.Field]) -> pa.RecordBatch:
    fields = [*keys, pa.field("fingerprint", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], names=[f.name for f in fields])


def svg(rooms: list[dict], walls: list[dict], scale: float = 100.0) -> str:
    """A plan as SVG text: rooms filled by kind, wall lengths in centimetres, unobserved walls red; z is flipped. For one plan of some tens of rows."""
    points = [p for r in rooms for p in r["polygon"]] or [(0.0, 0.0)]
    x0, z1 = min(p[0] for p in points) - 0.5, max(p[1] for p in points) + 0.5
    at = lambda x, z: f"{(x - x0) * scale:.1f},{(z1 - z) * scale:.1f}"
    out = ['<svg xmlns="http://www.w3.org/2000/svg">']
    out += [f'<polygon points="{" ".join(at(*p) for p in r["polygon"])}" fill="{"#ddd" if r.get("kind") == "connector" else "#eef"}"/>' for r in rooms]
    for w in walls:
        (a, b), (c, d) = (map(float, at(*w[k]).split(",")) for k in ("start", "end"))
        out.append(f'<line x1="{a}" y1="{b}" x2="{c}" y2="{d}" stroke="{"black" if w.get("observed", True) else "red"}"/><text x="{(a + c) / 2}" y="{(b + d) / 2}">{w["length"] * 100:.0f}</text>')
    return "\n".join([*out, "</svg>"])
