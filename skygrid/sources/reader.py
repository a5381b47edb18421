"""Opening catalogs, collections, margins, associations and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..catalog import AssociationCatalog, Catalog, MapCatalog, MarginCatalog, Stored
from ..operators.search import AbstractSearch
from ..plans.info import CatalogInfo
from ..plans.moc import Moc
from ..plans.pixels import HealpixPixel, sort_pixels
from . import layout

_MISTAKEN = {"margin": "margin_cache", "cache": "margin_cache", "maargin": "margin_cache", "column": "columns", "filter": "filters"}


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def open_catalog(path: str, search_filter: AbstractSearch | None = None, columns=None, margin_cache: str | None = None, error_empty_filter: bool = True, filters=None, path_generator=None, show_statistics: bool = False, **kwargs):
    """Open a point or map catalog, or a collection of one with its margins."""
    out = read_hats(path, search_filter, columns, margin_cache, error_empty_filter, filters, path_generator, **kwargs)
    if isinstance(out, (MarginCatalog, AssociationCatalog)):
        raise TypeError(f"{path} is an auxiliary dataset; read it with read_hats")
    return out


def read_hats(path: str, search_filter=None, columns=None, margin_cache=None, error_empty_filter=True, filters=None, path_generator=None, **kwargs):
    """Open a dataset of any type."""
    for k in kwargs:
        hint = _MISTAKEN.get(k)
        raise ValueError(f"unknown argument {k}" + (f"; did you mean {hint}?" if hint else ""))
    spark = _spark()
    path = path.rstrip("/")
    indexes: dict = {}
    main, margin_path = path, margin_cache
    if layout.exists(spark, f"{path}/{layout.COLLECTION}"):
        props = layout.parse_properties(layout.read_text(spark, f"{path}/{layout.COLLECTION}"))
        main = f"{path}/{props['hats_primary_table_url']}"
        names = props.get("all_margins", "").split()
        if margin_cache is None and props.get("default_margin"):
            margin_path = f"{path}/{props['default_margin']}"
        elif margin_cache in names:
            margin_path = f"{path}/{margin_cache}"
        for pair in props.get("all_indexes", "").split(","):
            words = pair.split()
            if len(words) == 2:
                indexes[words[0]] = spark.read.parquet(f"{path}/{words[1]}/dataset")
    cat = _dataset(spark, main, search_filter, columns, filters, error_empty_filter, path_generator)
    if isinstance(cat, Catalog):
        cat.indexes = indexes
        if margin_path:
            same = list(cat.info.default_columns or ()) or "all" if columns is None else columns  # a margin may lack defaults of its own
            m = _dataset(spark, margin_path, None, same, filters, False, path_generator, pixels_of=cat.tree.pixels if search_filter is not None else None)
            _same_columns(cat, m)
            if search_filter is not None and search_filter.fine:
                condition = search_filter.condition(m.info)
                m = m._each(lambda d: d.where(condition)) if condition is not None else m
            cat.margin = m
    return cat


def _same_columns(cat, margin):
    want = {f.name: f.dataType for f in cat.schema.fields}
    got = {f.name: f.dataType for f in margin.schema.fields if not f.name.startswith("__")}
    if want != got:
        raise ValueError("The margin catalog and the main catalog must have the same schema")
    if (cat.info.ra_column, cat.info.dec_column) != (margin.info.ra_column, margin.info.dec_column):
        raise ValueError("The margin catalog and the main catalog must have the same ra and dec columns")


def _info(props: dict) -> CatalogInfo:
    number = lambda k: int(props[k]) if props.get(k, "").isdigit() else None
    default = props.get("hats_cols_default", "").split()
    return CatalogInfo(
        props.get("obs_collection", "catalog"), props.get("dataproduct_type", "object"), props.get("hats_col_ra"), props.get("hats_col_dec"),
        props.get("hats_col_healpix") or "_healpix_29", number("hats_col_healpix_order") or 29, number("hats_nrows"), tuple(default) or None,
        float(props["hats_margin_threshold"]) if props.get("hats_margin_threshold") else None, props.get("hats_primary_table_url"), dict(props),
    )


def _properties(spark, path):
    for name in layout.PROPERTIES:
        if layout.exists(spark, f"{path}/{name}"):
            return layout.parse_properties(layout.read_text(spark, f"{path}/{name}"))
    raise FileNotFoundError(f"no catalog properties in {path}")


def _pixels(spark, path) -> list[HealpixPixel]:
    rows = layout.read_text(spark, f"{path}/{layout.PARTITION_INFO}").splitlines()
    head = rows[0].split(",")
    o, p = head.index("Norder"), head.index("Npix")
    return sort_pixels((int(r.split(",")[o]), int(r.split(",")[p])) for r in rows[1:] if r)


def _dataset(spark, path, search, columns, filters, error_empty, path_generator, pixels_of=None):
    """``pixels_of``: of a margin, only the files of these pixels."""
    props = _properties(spark, path)
    info = _info(props)
    kind = info.catalog_type
    if kind not in ("object", "source", "margin", "association", "map"):
        raise NotImplementedError(f"Cannot load dataset of type {kind}")
    pixels = _pixels(spark, path) if layout.exists(spark, f"{path}/{layout.PARTITION_INFO}") else []
    wanted = search.select_pixels(pixels) if search is not None else pixels
    if pixels_of is not None:
        wanted = [p for p in pixels if p in set(pixels_of)]
    if search is not None and not wanted and error_empty:
        raise ValueError("The selected sky region has no coverage")
    suffix = props.get("hats_npix_suffix", ".parquet")
    make = path_generator or (lambda root, p, s: f"{root}/dataset/{layout.pixel_file(*p, s)}")
    schema_file = next((f"{path}/dataset/{n}" for n in ("_common_metadata", "_metadata") if layout.exists(spark, f"{path}/dataset/{n}")), None)
    keys = kind == "margin"
    if not schema_file and not pixels:
        raise ValueError(f"The catalog at {path} has no schema metadata")
    # the schema comes from one file; with it given, no other is opened to plan a read
    schema_of = spark.read.option("recursiveFileLookup", "true").parquet(schema_file or make(path, pixels[0], suffix)).schema

    def load(some) -> DataFrame:
        if not some:
            raw = spark.createDataFrame([], schema_of)
        else:
            raw = spark.read.schema(schema_of).option("recursiveFileLookup", "true").parquet(*[make(path, p, suffix) for p in some])
        df = nest_structs(raw)
        if keys and "Norder" in df.columns:
            return df.withColumnRenamed("Norder", "__norder").withColumnRenamed("Npix", "__npix").drop("Dir")
        if keys:
            place = F.regexp_extract_all(F.input_file_name(), F.lit(r"(?:Norder|Npix)=(\d+)"), F.lit(1))
            return df.withColumns({"__norder": place[0].cast("int"), "__npix": place[1].cast("long")})
        return df if kind == "association" else df.drop(*layout.PARTITION_COLUMNS)

    empty = load([])
    schema = empty.schema
    index = info.healpix_column if info.healpix_column in empty.columns else None
    if index is None:
        info = info.copy(healpix_column=None)
    chosen = resolve_columns(empty, columns, info)

    def opened(some) -> DataFrame:
        df = load(some)
        if filters is not None:
            df = df.where(dnf(filters))
        if chosen is not None:
            df = project(df, [*([index] if index else []), *chosen, *(["__norder", "__npix"] if keys else [])])
        return df

    statistics = f"{path}/dataset/_statistics"
    if filters is not None or not layout.exists(spark, statistics):
        statistics = None
    moc = Moc.from_pixels(wanted)
    cls = {"margin": MarginCatalog, "association": AssociationCatalog, "map": MapCatalog}.get(kind, Catalog)
    cat = cls(None, info, wanted, moc, original_schema=schema, stored=Stored(opened, statistics=statistics))
    if search is not None or filters is not None:
        cat.info = cat.info.copy(total_rows=None)
    return cat.search(search) if search is not None else cat


def resolve_columns(df: DataFrame, columns, info: CatalogInfo):
    """None for every column; Ellipsis stands for the default columns; the
    position columns are always loaded."""
    if columns is None:
        columns = list(info.default_columns) if info.default_columns else None
    if columns is None or columns == "all":
        return None
    out: list[str] = []
    for c in [columns] if isinstance(columns, str) else columns:
        out += list(info.default_columns or ()) if c is ... else [c]
    out += [c for c in (info.ra_column, info.dec_column) if c and c not in out]
    return list(dict.fromkeys(out))


def project(df: DataFrame, names) -> DataFrame:
    subs: dict[str, list[str]] = {}
    order: list = []
    for n in names:
        base, _, sub = n.partition(".")
        if n in df.columns:
            order.append(F.col(f"`{n}`"))
        elif sub and base in df.columns:
            if base not in subs:
                order.append(base)
            subs.setdefault(base, []).append(sub)
        else:
            raise ValueError(f"Column {n} is not in the catalog")
    return df.select(*[F.transform(F.col(f"`{o}`"), _picker(subs[o])).alias(o) if isinstance(o, str) else o for o in order])


def _picker(fields):
    return lambda x: F.struct(*[x[f].alias(f) for f in fields])


def nest_structs(df: DataFrame) -> DataFrame:
    """Struct-of-lists columns (the format on disk) as arrays of structs."""
    cols = []
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, StructType) and t.fields and all(isinstance(s.dataType, ArrayType) for s in t.fields):
            zipped = F.arrays_zip(*[F.col(f"`{f.name}`.`{s.name}`").alias(s.name) for s in t.fields])
            cols.append(F.when(F.col(f"`{f.name}`").isNotNull(), zipped).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def unnest_structs(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, ArrayType) and isinstance(t.elementType, StructType):
            lists = F.struct(*[F.col(f"`{f.name}`")[s.name].alias(s.name) for s in t.elementType.fields])
            cols.append(F.when(F.col(f"`{f.name}`").isNotNull(), lists).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def dnf(filters):
    """[(column, op, value), ...] is a conjunction; a list of such lists a
    disjunction of them."""
    groups = filters if isinstance(filters[0], list) else [filters]
    ops = {
        "==": lambda c, v: c == v, "=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
        "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "in": lambda c, v: c.isin(list(v)), "not in": lambda c, v: ~c.isin(list(v)),
    }
    out = None
    for g in groups:
        part = None
        for name, op, value in g:
            if op not in ops:
                raise ValueError(f"unknown filter operator {op}")
            c = ops[op](F.col(f"`{name}`"), value)
            part = c if part is None else part & c
        out = part if out is None else out | part
    return out


__all__ = ["open_catalog", "read_hats"]
