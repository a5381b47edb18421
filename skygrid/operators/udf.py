"""Where a user supplies Python: row functions, partition functions, pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from ..plans.pixels import HealpixPixel
from .shipping import ship


def as_schema(meta) -> StructType:
    """A StructType from a schema, DDL text, dict, list of pairs, or an empty
    pandas frame or series."""
    if isinstance(meta, StructType):
        return meta
    if isinstance(meta, str):
        return StructType.fromDDL(meta)
    if isinstance(meta, pd.DataFrame):
        return frame_schema(meta)
    if isinstance(meta, pd.Series):
        return frame_schema(meta.to_frame(meta.name if meta.name is not None else "result"))
    pairs = meta.items() if isinstance(meta, dict) else meta
    return StructType([f for n, t in pairs for f in _field(n, t)])


_PANDAS = {"int64": "long", "int32": "int", "float64": "double", "float32": "float", "bool": "boolean", "object": "string", "str": "string", "float": "double", "int": "long"}


def _field(name, t):
    if not isinstance(t, str):
        t = getattr(t, "__name__", None) or str(t)
    return StructType.fromDDL(f"`{name}` {_PANDAS.get(t, t)}").fields


def frame_schema(frame: pd.DataFrame) -> StructType:
    import pyarrow as pa

    fixed = frame.copy()
    for c in fixed.columns:
        if fixed[c].dtype == object and not len(fixed):
            fixed[c] = fixed[c].astype("string")
    return from_arrow_schema(pa.Schema.from_pandas(fixed, preserve_index=False))


def empty_frame(schema: StructType) -> pd.DataFrame:
    kinds = {"long": "int64", "integer": "int32", "double": "float64", "float": "float32", "boolean": "bool", "string": "object"}
    return pd.DataFrame({f.name: pd.Series([], dtype=kinds.get(f.dataType.typeName(), "object")) for f in schema.fields})


def coerce(result) -> pd.DataFrame:
    """What a partition function returned, as a frame: a scalar is one row of
    ``result``, a list rows of it, a dict one row of columns."""
    if result is None:
        raise ValueError("the function returned None")
    if isinstance(result, pd.DataFrame):
        return result.reset_index(drop=True)
    if isinstance(result, pd.Series):
        return result.to_frame(result.name if result.name is not None else "result").reset_index(drop=True)
    if isinstance(result, dict):
        return pd.DataFrame({k: v if isinstance(v, (list, np.ndarray)) else [v] for k, v in result.items()})
    if isinstance(result, (list, tuple, np.ndarray)):
        return pd.DataFrame({"result": list(result)})
    return pd.DataFrame({"result": [result]})


def infer_schema(func, schema: StructType, meta, args, kwargs, include_pixel: bool) -> StructType:
    if meta is not None:
        return as_schema(meta)
    try:
        out = func(empty_frame(schema), *([HealpixPixel(0, 0)] if include_pixel else []), *args, **kwargs)
    except Exception as e:
        raise ValueError(f"cannot infer the result of {getattr(func, '__name__', func)} on an empty frame; pass meta=") from e
    got = coerce(out)
    known = {f.name: f for f in schema.fields}
    return StructType([known.get(f.name, f) for f in frame_schema(got).fields])


def infer_pair(func, left: StructType, right: StructType, args, kwargs) -> StructType:
    out = func(empty_frame(left), empty_frame(right), HealpixPixel(0, 0), HealpixPixel(0, 0), *args, **kwargs)
    if out is None:
        raise ValueError("the function returned None for empty inputs")
    known = {f.name: f for f in left.fields}
    return StructType([known.get(f.name, f) for f in frame_schema(coerce(out)).fields])


def _fit(frame: pd.DataFrame, schema: StructType) -> pd.DataFrame:
    return frame.reindex(columns=schema.names)


def map_partitions(df: DataFrame, partition, func, args, kwargs, schema: StructType, include_pixel: bool) -> DataFrame:
    """One call for each partition; a partition has a bounded number of rows."""
    ship(df.sparkSession)
    columns = df.columns
    name = getattr(func, "__name__", str(func))

    def run(key, pdf):
        pixel = HealpixPixel(int(key[0]), int(key[1]))
        try:
            return _fit(coerce(func(pdf[columns], *([pixel] if include_pixel else []), *args, **kwargs)), schema)
        except Exception as e:
            raise RuntimeError(f"function {name} failed on partition {pixel}: {e}") from e

    keyed = df.withColumns({"__po": partition[0], "__pp": partition[1]}).where("__po is not null")
    return keyed.groupBy("__po", "__pp").applyInPandas(run, schema)


def filter_frames(df: DataFrame, fn) -> DataFrame:
    ship(df.sparkSession)

    def run(frames):
        for f in frames:
            yield fn(f)

    return df.mapInPandas(run, df.schema)


def row_schema(meta, output_names, infer_nesting: bool):
    """(schema, how to pack a row's results): dotted names gather in a nested
    column when nesting is inferred."""
    flat = as_schema(meta)
    if output_names is not None:
        names = [output_names] if isinstance(output_names, str) else list(output_names)
        flat = StructType([StructField(n, f.dataType) for n, f in zip(names, flat.fields)])
    if not infer_nesting or not any("." in f.name for f in flat.fields):
        return flat, [(f.name, None) for f in flat.fields]
    out, plan, subs = [], [], {}
    for f in flat.fields:
        base, _, sub = f.name.partition(".")
        if not sub:
            out.append(f)
            plan.append((f.name, None))
        else:
            if base not in subs:
                subs[base] = []
                out.append(base)
                plan.append((base, subs[base]))
            element = f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType
            subs[base].append((f.name, sub, element))
    fields = [StructField(f, ArrayType(StructType([StructField(s, t) for _, s, t in subs[f]]))) if isinstance(f, str) else f for f in out]
    return StructType(fields), plan


def map_rows(df: DataFrame, func, names, keep, schema: StructType, plan, container: str, kwargs) -> DataFrame:
    ship(df.sparkSession)
    full = StructType([*[df.schema[c] for c in keep], *schema.fields])
    inputs = []
    for i, n in enumerate(names):
        base, _, sub = n.partition(".")
        inputs.append((F.col(f"`{n}`") if n in df.columns else F.col(f"`{base}`")[sub]).alias(f"__in{i}"))
    order = [x for n, s in plan for x in ([n] if s is None else [y[0] for y in s])]

    def run(frames):
        for f in frames:
            rows = []
            for vals in zip(*(f[f"__in{i}"] for i in range(len(names)))):
                got = func(*vals, **kwargs) if container == "args" else func(dict(zip(names, vals)), **kwargs)
                if not isinstance(got, dict):
                    seq = got if isinstance(got, (tuple, list)) and len(order) > 1 else [got]
                    got = dict(zip(order, seq))
                rows.append(got)
            out = {c: f[c] for c in keep}
            for n, s in plan:
                if s is None:
                    out[n] = [r.get(n, r.get(str(n))) for r in rows]
                else:
                    out[n] = [[dict(zip([y[1] for y in s], v)) for v in zip(*(r[y[0]] for y in s))] for r in rows]
            yield pd.DataFrame(out, columns=full.names)

    return df.select(*[F.col(f"`{c}`") for c in keep], *inputs).mapInPandas(run, full)


def _pixel(text: str) -> HealpixPixel:
    o, p = text.split(":")
    return HealpixPixel(int(o), int(p))


def pairwise(left: DataFrame, right: DataFrame, func, args, kwargs, schema, lindex, rindex) -> DataFrame:
    ship(left.sparkSession)

    def run(key, a, b):
        lp, rp = key[0].split("|")
        if a.empty:
            return empty_frame(schema)
        a = a.drop(columns="__pair").sort_values(lindex, ignore_index=True)
        b = b.drop(columns="__pair").sort_values(rindex, ignore_index=True)
        return _fit(coerce(func(a, b, _pixel(lp), _pixel(rp), *args, **kwargs)), schema)

    return left.groupBy("__pair").cogroup(right.groupBy("__pair")).applyInPandas(run, schema)


def match_pairs(left: DataFrame, right: DataFrame, algo, lcols, rcols, extra, schema: StructType, how: str) -> DataFrame:
    """The algorithm on every pair of partitions. Its frames are one pair's rows (of
    the left side ``left_rows`` at most, if it says so); what it matched leaves in
    batches and is never a frame of its own."""
    import pyarrow as pa

    spark = left.sparkSession
    ship(spark)
    zone, kinds, most = spark.conf.get("spark.sql.session.timeZone"), to_arrow_schema(schema), getattr(algo, "left_rows", None)
    cell = lambda names: F.struct(*[F.col(f"`{c}`") for c in names])
    both = left.select("__pair", F.lit(1).alias("__side"), cell(lcols).alias("__l"))
    both = both.unionByName(right.select("__pair", F.lit(0).alias("__side"), cell(rcols).alias("__r")), allowMissingColumns=True)
    both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "__pair").sortWithinPartitions("__pair", "__side")

    def table(parts, names, at):
        if not sum(map(len, parts)):
            return pa.table([pa.array([], k.type) for k in list(kinds)[at : at + len(names)]], names=names)
        return pa.table(pa.concat_arrays(parts).flatten(), names=names)

    def frame(t):
        out = t.to_pandas()
        for f in t.schema:
            if pa.types.is_timestamp(f.type) and f.type.tz:
                out[f.name] = out[f.name].dt.tz_convert(zone).dt.tz_localize(None)
        return out

    def matched(a, b):
        if not a.num_rows or not b.num_rows:
            li, ri, ex = np.zeros(0, int), np.zeros(0, int), pd.DataFrame({c: [] for c in extra})
        else:
            li, ri, ex = algo.perform_crossmatch(frame(a), frame(b))
            if not len(li) == len(ri) == len(ex):
                raise ValueError("the algorithm's results differ in length")
        more = list(kinds)[len(lcols) + len(rcols) :]
        for s in range(0, len(li), 20_000):
            one, other = (pa.array(np.asarray(x)[s : s + 20_000]) for x in (li, ri))
            found = [pa.array(ex[f.name].iloc[s : s + 20_000], f.type, from_pandas=True) for f in more]
            yield [*a.take(one).columns, *b.take(other).columns, *found]
        if how == "left":
            rest = a.take(pa.array(np.setdiff1d(np.arange(a.num_rows), li)))
            if rest.num_rows:
                yield [*rest.columns, *[pa.nulls(rest.num_rows, t) for t in [*b.schema.types, *[f.type for f in more]]]]

    def pair(rights, lefts):
        a, b = table(lefts, lcols, 0), table(rights, rcols, len(lcols))
        step = most or max(a.num_rows, 1)
        for s in range(0, a.num_rows, step):
            for columns in matched(a.slice(s, step).combine_chunks(), b):
                yield from pa.table(columns, names=schema.names).to_batches()

    def run(batches):
        now, rights, lefts = None, [], []
        for batch in batches:
            keys = np.asarray(batch.column("__pair").to_pylist(), dtype=object)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if keys[s] != now:
                    yield from pair(rights, lefts)
                    now, rights, lefts = keys[s], [], []
                part = batch.slice(s, e - s)
                n = int((part.column("__side").to_numpy() == 0).sum())
                rights.append(part.column("__r").slice(0, n))
                lefts.append(part.column("__l").slice(n))
        yield from pair(rights, lefts)

    return both.mapInArrow(run, schema)
