"""Behaviour beyond the registered queries: validation, metadata, round trips."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import skygrid
from skygrid.functions import healpix as hp
from skygrid.operators.margin import empty_pixels
from skygrid.plans.expr import QueryError, translate
from skygrid.plans.moc import Moc
from skygrid.plans.pixels import HealpixPixel, PixelTree, adaptive_pixels


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 400
    return pd.DataFrame({"id": np.arange(n), "ra": rng.uniform(0, 360, n), "dec": np.degrees(np.arcsin(rng.uniform(-1, 1, n))), "mag": rng.normal(20, 2, n)})


@pytest.fixture(scope="module")
def cat(spark, frame):
    return skygrid.from_dataframe(frame, catalog_name="sky", partition_rows=60, highest_order=4, margin_threshold=3600.0 * 2)


def test_pixels_agree_with_centres():
    for k in range(6):
        p = np.arange(12 * 4**k)
        assert (hp.ang2pix_np(k, *hp.pix2ang_np(k, p)) == p).all()


def test_column_pixels_equal_array_pixels(cat, frame):
    got = cat.df.select("id", "_healpix_29").toPandas().set_index("id")["_healpix_29"]
    want = hp.ang2pix_np(29, frame.ra, frame.dec)
    assert (got.loc[frame.id].to_numpy() == want).all()


def test_margin_cells_touch_and_surround():
    cells = hp.margin_cells(1, 44, 4)
    assert 32 <= len(cells) <= 36 and not any(c >> 6 == 44 for c in cells)


def test_partitions_hold_every_row_once(cat, frame):
    counts = cat.per_partition_statistics(include_columns=["id"]).toPandas()
    assert counts["id: row_count"].sum() == len(frame) and counts["id: row_count"].max() <= 60
    assert counts[["norder", "npix"]].isna().sum().sum() == 0


def test_adaptive_pixels_are_disjoint():
    rng = np.random.default_rng(1)
    hist = {int(k): int(v) for k, v in zip(rng.choice(12 * 256, 300, replace=False), rng.integers(1, 50, 300))}
    got = adaptive_pixels(hist, 4, 0, 100)
    ranges = [hp.pixel_range(*p) for p in got]
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    inside = sum(any(lo <= hp.pixel_range(4, p)[0] < hi for lo, hi in ranges) for p in hist)
    assert inside == len(hist)


def test_empty_pixels_complete_the_sky():
    some = [(1, 5), (2, 3), (0, 7)]
    assert Moc.from_pixels([*some, *empty_pixels(some)]).ranges == [(0, 12 << 58)]


def test_moc_algebra():
    a, b = Moc([(0, 10), (20, 30)]), Moc([(5, 25)])
    assert a.union(b).ranges == [(0, 30)] and a.intersection(b).ranges == [(5, 10), (20, 25)]
    assert Moc([(0, 1), (5, 6), (100, 101)]).simplified(2).ranges == [(0, 6), (100, 101)]


@pytest.mark.parametrize("make", [
    lambda: skygrid.ConeSearch(0, 95, 1), lambda: skygrid.ConeSearch(0, 0, 0), lambda: skygrid.BoxSearch((0, 1), (3, 3)),
    lambda: skygrid.BoxSearch((0,), (0, 1)), lambda: skygrid.PolygonSearch([(0, 0), (1, 1)]), lambda: skygrid.PolygonSearch([(0, 0), (1, 1), (1, 1)]),
    lambda: skygrid.PolygonSearch([(0, 0), (10, 0), (2, 1), (0, 10)]), lambda: skygrid.PixelSearch([]), lambda: skygrid.PixelSearch("x"),
    lambda: skygrid.OrderSearch(3, 1), lambda: skygrid.IndexSearch({}), lambda: skygrid.IndexSearch({"a": [1], "b": [2]}),
    lambda: skygrid.KdTreeCrossmatch(0), lambda: skygrid.KdTreeCrossmatch(1, 0), lambda: skygrid.KdTreeCrossmatch(1, 1, 2),
])
def test_bad_parameters(make):
    with pytest.raises(ValueError):
        make()


def test_whole_circle_boxes(cat, frame):
    for ra in ((0, 0), (0, 360), (360, 0)):
        assert cat.box_search(ra, (-90, 90)).count() == len(frame)
    inside = cat.box_search((280, 300), (-90, 90)).count()
    assert inside + cat.box_search((300, 280), (-90, 90)).count() == len(frame)


def test_cone_against_vectors(cat, frame):
    c = hp.xyz_np(50, 30)
    want = (hp.xyz_np(frame.ra, frame.dec) @ c >= np.cos(np.radians(25))).sum()
    assert cat.cone_search(50, 30, 25 * 3600).count() == want
    assert cat.cone_search(50, 30, 25 * 3600, fine=False).count() >= want


def test_names(cat):
    with pytest.raises(KeyError):
        cat[["nothing"]]
    with pytest.raises(KeyError):
        cat.drop(["nothing"])
    assert cat.drop(["nothing"], errors="ignore").columns == cat.columns
    assert cat.rename({"ra": "alpha"}).info.ra_column == "alpha"
    assert cat.rename_catalog("x").margin.name == "x_7200arcs"
    with pytest.raises(NotImplementedError):
        cat.iloc
    with pytest.raises(ValueError):
        len(cat.query("mag > 20"))
    assert len(cat) == 400


def test_query_strings(cat, frame):
    for text in ("mag > 20 and dec < 0", "not (mag > 20) or ra < 10", "18 < mag <= 21.5", "mag > 20 & dec < 0 | id == 3", "`mag` * 2 > 41 and id in [1, 2, 3]"):
        assert cat.query(text).count() == len(frame.query(text)), text
    for bad in ("@x > 1", "mag >", "f(mag)", "unknown > 1"):
        with pytest.raises(QueryError):
            translate(bad, cat.df.schema)


def test_nan_in_queries(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None)], "id long, v double")
    f = lambda t: sorted(r.id for r in df.where(translate(t, df.schema)[0]).collect())
    assert f("v > 0") == [2] and f("v != 5") == [1, 2]


def brute(a, b, r, n, rmin=0.0):
    d = np.degrees(2 * np.arcsin(np.linalg.norm(hp.xyz_np(a.ra, a.dec)[:, None] - hp.xyz_np(b.ra, b.dec)[None], axis=2) / 2)) * 3600
    out = set()
    for i in range(len(a)):
        near = sorted((x, j) for j, x in enumerate(d[i]) if x < r and (rmin == 0 or x > rmin))[:n]
        out |= {(int(a.id.iloc[i]), int(b.id.iloc[j])) for _, j in near}
    return out


@pytest.mark.parametrize("r,n,rmin", [(18000.0, 1, 0), (18000.0, 3, 7200.0), (90000.0, 4, 0)])
def test_crossmatch_against_brute_force(spark, cat, frame, r, n, rmin):
    other = frame.sample(150, random_state=2).assign(ra=lambda f: (f.ra + 1.3) % 360)
    b = skygrid.from_dataframe(other, catalog_name="b", margin_threshold=None)
    got = cat.crossmatch(b, radius_arcsec=r, n_neighbors=n, min_radius_arcsec=rmin, suffix_method="all_columns").df
    assert {(x.id_sky, x.id_b) for x in got.collect()} == brute(frame, other, r, n, rmin)


def test_crossmatch_arguments(cat):
    with pytest.raises(ValueError):
        cat.crossmatch(cat, algorithm=skygrid.KdTreeCrossmatch(), radius_arcsec=2.0, suffix_method="all_columns")
    with pytest.raises(ValueError):
        cat.crossmatch(cat, suffixes=("a",), suffix_method="all_columns")
    with pytest.raises(ValueError):
        cat.crossmatch(cat, how="outer", suffix_method="all_columns")
    with pytest.warns(FutureWarning):
        assert cat.crossmatch(cat, radius_arcsec=5.0).count() == 400


def test_frames_crossmatch(frame, spark):
    out = skygrid.crossmatch(frame, frame, radius_arcsec=1.0, suffix_method="all_columns")
    assert out.count() == len(frame)
    with pytest.raises(TypeError):
        skygrid.crossmatch(frame, 3)


def test_margin_follows_operators(cat):
    small = cat.query("mag > 20")[["id", "ra", "dec"]]
    assert small.margin is not None and "__norder" in small.margin.df.columns
    rows = small.margin.df.join(cat.df.select(F.col("id").alias("i"), "mag"), F.col("id") == F.col("i"))
    assert rows.where("mag <= 20").count() == 0


def test_round_trip(cat, tmp_path, frame):
    cat.write_catalog(str(tmp_path / "c"), create_thumbnail=True, create_summary=True, skymap_alt_orders=[1])
    back = skygrid.open_catalog(str(tmp_path / "c"))
    assert back.get_healpix_pixels() == cat.get_healpix_pixels() and len(back) == len(frame)
    assert back.compute()[["id", "ra"]].equals(cat.compute()[["id", "ra"]])
    assert back.margin.count() == cat.margin.count()
    cut = skygrid.open_catalog(str(tmp_path / "c"), search_filter=skygrid.ConeSearch(50, 30, 3600 * 40), columns=["mag"], filters=[("mag", ">", 20)])
    assert cut.columns == ["mag", "ra", "dec"]
    assert cut.count() == cat.cone_search(50, 30, 3600 * 40).query("mag > 20").count()
    with pytest.raises(ValueError, match="margin_cache"):
        skygrid.open_catalog(str(tmp_path / "c"), margin="x")
    with pytest.raises(ValueError):
        cat.write_catalog(str(tmp_path / "c"))
    cat.write_catalog(str(tmp_path / "c"), resume=True)
    with pytest.raises(ValueError):
        cat.write_catalog(str(tmp_path / "c"), resume=True, overwrite=True)
    with pytest.raises(RuntimeError):
        cat.query("mag > 1000").write_catalog(str(tmp_path / "d"))


ROOT = []


@pytest.fixture(scope="module")
def stored(cat, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "c")
    ROOT.append(path)
    cat.write_catalog(path, should_write_skymap=False)
    return skygrid.open_catalog(path)


def files(df):
    return sorted(re.search(r"Norder=(\d+)/Dir=\d+/Npix=(\d+)", f).groups() for f in df.inputFiles())


def names(pixels):
    return sorted((str(o), str(p)) for o, p in pixels)


def test_searches_after_opening_read_only_their_files(stored, cat):
    searches = {
        "cone": lambda c: c.cone_search(50, 30, 3600 * 20), "box": lambda c: c.box_search((10, 50), (0, 40)), "coarse": lambda c: c.cone_search(50, 30, 3600 * 20, fine=False),
        "pixels": lambda c: c.pixel_search([(3, 5), (2, 100)]), "partition": lambda c: c.get_partition(*c.get_healpix_pixels()[3]), "slice": lambda c: c.partitions[2:5],
        "steps": lambda c: c.query("mag > 19")[["id", "ra", "dec", "mag"]].rename({"mag": "m"}).cone_search(50, 30, 3600 * 20).query("m < 22"),
        "twice": lambda c: c.cone_search(50, 30, 3600 * 30).box_search((30, 60), (10, 50)), "polygon": lambda c: c.polygon_search([(40, 20), (60, 20), (50, 40)]),
    }
    for name, search in searches.items():
        got, want = search(stored), search(cat)
        assert files(got.df) == names(got.get_healpix_pixels()) and len(got.get_healpix_pixels()) < stored.npartitions, name
        assert got.get_healpix_pixels() == want.get_healpix_pixels()
        assert sorted(r.id for r in got.df.collect()) == sorted(r.id for r in want.df.collect()), name
        key = lambda m: sorted((r["__norder"], r["__npix"], r.id) for r in m.df.collect())
        assert key(got.margin) == key(want.margin), name
        assert set(files(got.margin.df)) <= set(names(got.get_healpix_pixels())), name


def test_margin_of_a_partition_is_what_it_receives(cat):
    p = max(cat.get_healpix_pixels(), key=lambda p: cat.margin.df.where((F.col("__norder") == p.order) & (F.col("__npix") == p.pixel)).count())
    margin = cat.get_partition(*p).margin
    rows = margin.df.collect()
    assert rows and all((r["__norder"], r["__npix"]) == p for r in rows)
    lo, hi = hp.pixel_range(*p)
    assert not any(lo <= r["_healpix_29"] < hi for r in rows)


def test_written_statistics_save_a_scan(stored, cat):
    cols = {"include_columns": ["mag", "id"]}
    key = lambda f: sorted(map(str, f.collect()))
    got, want = stored.per_partition_statistics(**cols), cat.per_partition_statistics(**cols)
    assert key(got.select(*want.columns)) == key(want)
    assert all("/_statistics/" in f for f in got.inputFiles())
    some = cat.get_healpix_pixels()[2:4]
    assert key(stored.per_partition_statistics(include_pixels=some, **cols)) == key(cat.per_partition_statistics(include_pixels=some, **cols).select(*got.columns))
    assert key(stored.aggregate_column_statistics(**cols)) == key(cat.aggregate_column_statistics(**cols))
    with pytest.warns(UserWarning):  # rows have gone: counted anew
        cut = stored.query("mag > 20").aggregate_column_statistics(**cols)
    assert key(cut) == key(cat.query("mag > 20").aggregate_column_statistics(warn_on_modified_catalog=False, **cols))


def test_opening_looks_at_no_data_file(stored, cat, spark, tmp_path):
    import shutil

    from skygrid.sources import layout

    made = layout.read_text(spark, f"{ROOT[0]}/sky/{layout.PROPERTIES[0]}")
    shutil.copytree(f"{ROOT[0]}/sky/dataset", tmp_path / "dataset", ignore=lambda d, names: [n for n in names if n.startswith("Norder=")])
    (tmp_path / layout.PROPERTIES[0]).write_text(made)
    (tmp_path / layout.PARTITION_INFO).write_text("Norder,Npix\n" + "\n".join(f"7,{p}" for p in range(0, 12 * 4**7, 40)))
    many = skygrid.open_catalog(str(tmp_path))  # none of its files is there
    assert many.npartitions == -(-12 * 4**7 // 40) and many.columns == stored.columns and "mag" in repr(many)
    near = many.query("mag > 20")[["id", "ra", "dec"]].cone_search(10, 10, 3600)
    assert 0 < near.npartitions < 40 and near.columns == ["id", "ra", "dec"]
    with pytest.raises(Exception):
        many.query("nothing > 1")


def test_head_visits_the_first_files(stored, cat):
    assert stored.head(3).id.tolist() == cat.head(3).id.tolist() and stored.tail(3).id.tolist() == cat.tail(3).id.tolist()
    assert len(stored.query("mag > 22").head(1000)) == cat.query("mag > 22").count()


def test_id_search_needs_an_index(cat, frame):
    with pytest.raises(TypeError, match="no index"):
        cat.id_search({"id": 3})
    found = cat.id_search({"id": [3, 5]}, {"id": cat.build_index("id")})
    assert sorted(r.id for r in found.df.collect()) == [3, 5] and found.npartitions <= 2


def test_membership_in_many_ranges(spark):
    rng = np.random.default_rng(4)
    for n, order in ((50, 29), (10_000, 29), (3_000, 13)):
        step = 2 * (29 - order)
        edges = np.sort(rng.choice(1 << 40, 2 * n, replace=False)) << 20 >> step
        moc = Moc((int(a) << step, int(b) << step) for a, b in edges.reshape(-1, 2) if a < b)
        inside = sum(((b - 1) - ((a - 1))) for a, b in moc.ranges)
        assert sum((1 << 2 * (29 - o)) * len(p) for o, p in moc.cells().items()) == inside
        values = np.r_[edges, edges - 1, edges + 1, rng.integers(0, 12 << (2 * order), 3000)]
        frame = spark.createDataFrame(pd.DataFrame({"i": values}))
        got = {r.i for r in frame.where(moc.contains("i", order)).collect()}
        ends = np.array([x for r in moc.ranges for x in r]) >> step
        assert got == {int(v) for v in values if np.searchsorted(ends, v, side="right") % 2}


def test_moc_of_cells():
    for cells in ([], [3], [3, 4, 5, 9], [0, 2, 3, 47]):
        assert Moc.from_cells(1, np.array(cells, int)) == Moc.from_pixels((1, c) for c in cells)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_against_brute_force(spark, direction):
    rng = np.random.default_rng(8)
    make = lambda n, name, s: skygrid.from_dataframe(pd.DataFrame({"id": np.arange(n), "ra": rng.uniform(40, 80, n), "dec": rng.uniform(-20, 40, n)}), catalog_name=name, margin_threshold=None, lowest_order=s, highest_order=3)
    left, right = make(300, "l", 0), make(60, "r", 1)
    got = {r.id_l: r.id_r for r in left.merge_asof(right, direction, suffix_method="all_columns").df.collect()}
    place = lambda c: sorted((r["_healpix_29"], r.id) for r in c.df.collect())
    rights, want = place(right), {}
    for h, i in place(left):
        home = [p for p in right.get_healpix_pixels() if hp.pixel_range(*p)[0] <= h < hp.pixel_range(*p)[1]]
        if not home:
            continue
        lo, hi = hp.pixel_range(*home[0])
        here = [(x, j) for x, j in rights if lo <= x < hi and (direction == "nearest" or (x <= h if direction == "backward" else x >= h))]
        want[i] = min(here, key=lambda t: (abs(t[0] - h), t[0] > h))[1] if here else None
    assert got == want and sum(v is not None for v in want.values()) > 100


def test_asof_reads_no_frame_ahead(spark, cat):
    """Both ways are running windows: a frame that ends at the last row is
    evaluated anew for each row."""
    plan = cat.merge_asof(cat, "nearest", suffix_method="all_columns").df._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()


def test_association_round_trip(cat, tmp_path):
    links = cat.crossmatch(cat, radius_arcsec=5.0, suffixes=("_a", "_b"), suffix_method="all_columns")
    links.to_association(
        str(tmp_path / "assn"), catalog_name="links", primary_catalog_dir="a", primary_column_association="id_a", primary_id_column="id",
        join_catalog_dir="b", join_column_association="id_b", join_id_column="id", separation_column="_dist_arcsec",
    )
    assn = skygrid.read_hats(str(tmp_path / "assn"))
    assert assn.max_separation == 0 and cat.join(cat, through=assn, suffixes=("_a", "_b"), suffix_method="all_columns").count() == 400
    with pytest.raises(TypeError):
        skygrid.open_catalog(str(tmp_path / "assn"))


def test_nested_round_trip(spark, tmp_path):
    cat = skygrid.generate_catalog(spark, 60, 5, seed=3)
    cat.write_catalog(str(tmp_path / "n"))
    back = skygrid.open_catalog(str(tmp_path / "n"), columns=["id", "nested.flux"])
    assert back.exploded_columns == ["id", "nested", "ra", "dec", "nested.flux"]
    assert back.df.select(F.sum(F.size("nested"))).first()[0] == 300
    bright = cat.query("nested.flux > 50").df
    assert bright.count() == 60 and bright.where("exists(nested, x -> x.flux <= 50)").count() == 0


def test_map_rows_nesting(spark):
    cat = skygrid.generate_catalog(spark, 20, 4, seed=1)
    out = cat.map_rows(lambda r: {"n.t": list(r["nested.t"]), "top": float(max(r["nested.flux"]))}, columns=["nested.t", "nested.flux"], meta={"n.t": "double", "top": "double"})
    assert out.nested_columns == ["n"] and out.info.ra_column is None
    more = cat.map_rows(lambda a, b: a + b, columns=["a", "b"], row_container="args", meta={"s": "double"}, append_columns=True)
    assert more.df.where("abs(s - a - b) > 1e-9").count() == 0


def test_partition_functions(cat):
    one = cat.map_partitions(lambda f: len(f), meta={"result": "long"}).df
    assert one.agg(F.sum("result")).first()[0] == 400 and one.count() == cat.npartitions
    assert cat.map_partitions(lambda f: len(f), compute_single_partition=True, partition_index=0) == len(cat.partitions[0].compute())

    def boom(frame):
        raise ZeroDivisionError("boom")

    with pytest.raises(Exception, match="function boom failed on partition"):
        cat.map_partitions(boom, meta={"x": "long"}).count()


def test_concat_rules(cat, frame):
    with pytest.raises(TypeError):
        cat.concat(skygrid.from_dataframe(frame.assign(mag="x"), margin_threshold=None))
    with pytest.raises(ValueError):
        cat.concat(cat.rename({"ra": "alpha"}))
    both = cat.concat(cat)
    assert both.count() == 800 and both.margin is not None


def test_streams(cat):
    s = skygrid.CatalogStream(cat, partitions_per_chunk=3, seed=1)
    assert len(s) == -(-cat.npartitions // 3) and sum(len(f) for f in s) == 400
    endless = iter(skygrid.InfiniteStream(cat, partitions_per_chunk=2, seed=1))
    assert len(next(endless)) and len(next(endless))
    with pytest.raises(TypeError):
        len(endless)
    with pytest.raises(ValueError):
        skygrid.CatalogStream(3)


def test_sampling_and_order(cat):
    assert cat.random_sample(5, seed=1).equals(cat.random_sample(5, seed=1))
    with pytest.raises(IndexError):
        cat.sample(10_000)
    head, tail = cat.head(3), cat.tail(3)
    assert head["_healpix_29"].is_monotonic_increasing and tail["_healpix_29"].min() >= head["_healpix_29"].max()


def test_loader_checks(frame, spark):
    with pytest.raises(ValueError):
        skygrid.from_dataframe(frame.assign(ra=np.nan))
    with pytest.raises(ValueError):
        skygrid.from_dataframe(frame.rename(columns={"ra": "x"}))
    with pytest.raises(ValueError):
        skygrid.from_dataframe(frame, partition_rows=1, partition_bytes=1)
    with pytest.raises(ValueError):
        skygrid.from_dataframe(frame, catalog_type="margin")
    with pytest.raises(ValueError):
        skygrid.from_dataframe(frame, margin_threshold=-1.0)
    t = skygrid.from_astropy({"ra": frame.ra.to_numpy(), "dec": frame.dec.to_numpy(), "m": np.ones((len(frame), 2))}, margin_threshold=None)
    assert dict(t.df.dtypes)["m"] == "array<double>"


def test_alignment():
    a, b = PixelTree([(0, 0), (1, 44)]), PixelTree([(1, 1), (0, 11)])
    assert a.align(b) == [(HealpixPixel(0, 0), HealpixPixel(1, 1), HealpixPixel(1, 1)), (HealpixPixel(1, 44), HealpixPixel(0, 11), HealpixPixel(1, 44))]
    assert repr(skygrid.show_versions())


def test_coverage_comes_with_the_histogram(spark, frame):
    for highest, moc in ((7, 10), (7, 9), (4, 5), (3, 10), (5, 5)):
        c = skygrid.from_dataframe(frame, highest_order=highest, moc_max_order=moc, margin_threshold=None)
        assert c.moc == Moc.from_pixels(zip([moc] * len(frame), hp.ang2pix_np(moc, frame.ra, frame.dec)))


def test_outlines(cat):
    cone, box = skygrid.ConeSearch(50, 30, 3600 * 10), skygrid.BoxSearch((350, 20), (-5, 40))
    ra, dec = cone.outline()
    d = np.degrees(np.arccos(hp.xyz_np(ra, dec) @ hp.xyz_np(50, 30)))
    assert np.allclose(d, 10)
    ra, dec = box.outline()
    assert ((dec >= -5) & (dec <= 40) & ((ra >= 350) | (ra <= 20 + 1e-9))).all()
    poly = skygrid.PolygonSearch([(0, 0), (30, 0), (30, 30)])
    assert (hp.xyz_np(*poly.outline()) @ poly.normals.T >= -1e-9).all()
    with pytest.raises(NotImplementedError):
        skygrid.OrderSearch(0, 1).plot()
