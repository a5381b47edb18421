"""Matches with many rows within the radius, and rows that share a place or a cell."""

import numpy as np
import pandas as pd
import pytest

import skygrid
from skygrid.functions import healpix as hp
from skygrid.operators.nearest import nearest

R = 7200.0
CASES = {}


def places(n, seed, copies=1):
    """A field near the pole, each place several times."""
    r = np.random.default_rng(seed)
    ra, dec = r.uniform(0, 60, n), r.uniform(78, 86, n)
    return pd.DataFrame({"id": np.arange(n * copies), "ra": np.tile(ra, copies), "dec": np.tile(dec, copies)})


A, B = places(900, 1), places(1100, 2, 3)


def cat(frame, name, **kw):
    return skygrid.from_dataframe(frame, catalog_name=name, margin_threshold=None, should_generate_moc=False, **kw)


def want(a, b, n, low=0.0, same=None):
    d = np.degrees(2 * np.arcsin(np.minimum(1, np.linalg.norm(hp.xyz_np(a.ra, a.dec)[:, None] - hp.xyz_np(b.ra, b.dec)[None], axis=2) / 2))) * 3600
    if same is not None:
        d = np.where(same, d, np.inf)
    out = {}
    for i in range(len(a)):
        near = sorted((round(x, 4), j) for j, x in enumerate(d[i]) if x < R and (low == 0 or x > low))[:n]
        out[int(a.id.iloc[i])] = [(int(b.id.iloc[j]), x) for x, j in near]
    return out


def matched(out, left="id_a", right="id_b"):
    """Left id to (right id, distance) in order; the plan neither joins nor gathers."""
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    got = {}
    for x in sorted(out.collect(), key=lambda x: (round(x["_dist_arcsec"] or 0, 4), x[right] or 0)):
        got.setdefault(x[left], []).extend([(x[right], round(x["_dist_arcsec"], 4))] if x[right] is not None else [])
    return got


def agree(got, expected, empty=False):
    expected = {k: v for k, v in expected.items() if v or empty}
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert [x for x, _ in got[k]] == [x for x, _ in v] and np.allclose([d for _, d in got[k]], [d for _, d in v], atol=2e-4)


def case(fn):
    CASES[fn.__name__] = fn
    return fn


@case
def minmax(spark):
    out = cat(A, "a").crossmatch(cat(B, "b"), radius_arcsec=R, n_neighbors=2, min_radius_arcsec=2400.0, suffix_method="all_columns").df
    agree(matched(out), want(A, B, 2, 2400.0))


@case
def three(spark):
    out = cat(A, "a").crossmatch(cat(B, "b"), radius_arcsec=R, n_neighbors=3, suffix_method="all_columns").df
    agree(matched(out), want(A, B, 3))


@case
def nested_contents(spark):
    out = cat(A, "a").crossmatch_nested(cat(B, "b"), radius_arcsec=R, n_neighbors=3, nested_column_name="m").df
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    agree({x.id: [(y.id, round(y["_dist_arcsec"], 4)) for y in x.m] for x in out.collect()}, want(A, B, 3))


@case
def suffixes(spark):
    out = cat(A.rename(columns={"id": "key"}), "a").crossmatch(cat(B, "b"), radius_arcsec=R, suffixes=("_l", "_r"), suffix_method="all_columns").df
    agree(matched(out, "key_l", "id_r"), want(A, B, 1))


@case
def one(spark):
    out = cat(A, "a").crossmatch(cat(B, "b"), radius_arcsec=R, suffix_method="all_columns").df
    agree(matched(out), want(A, B, 1))


@case
def nested_left(spark):
    out = cat(A, "a").crossmatch_nested(cat(B[B.ra < 30], "b"), radius_arcsec=R, n_neighbors=3, nested_column_name="m", how="left").df
    agree({x.id: [(y.id, round(y["_dist_arcsec"], 4)) for y in x.m or []] for x in out.collect()}, want(A, B[B.ra < 30], 3), empty=True)


@case
def of_frames(spark):
    kw = {"should_generate_moc": False, "margin_threshold": None}
    out = skygrid.crossmatch(A, B, radius_arcsec=R, suffixes=("_a", "_b"), suffix_method="all_columns", left_args=kw, right_args=kw).df
    agree(matched(out), want(A, B, 1))


@case
def through_links(spark):
    from skygrid.catalog import AssociationCatalog
    from skygrid.operators import joins
    from skygrid.plans.info import CatalogInfo

    a, b = cat(A, "a"), cat(B, "b")
    links = a.crossmatch(b, radius_arcsec=R, suffix_method="all_columns")
    keys = {"primary_column": "id", "primary_column_association": "x", "join_column": "id", "join_column_association": "y"}
    table = links.df.selectExpr("id_a as x", "id_b as y", "_dist_arcsec")
    most, joins.LARGE = joins.LARGE, 10
    try:
        out = a.join(b, through=AssociationCatalog(table, CatalogInfo("links", "association", None, None, extra=keys), links.tree.pixels), suffix_method="all_columns").df
    finally:
        joins.LARGE = most
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {x.id_a: [(x.id_b, round(x["_dist_arcsec"], 4))] for x in out.collect()}
    agree(got, want(A, B, 1))


@case
def association(spark):
    import tempfile

    from skygrid.sources.reader import read_hats

    links = cat(A, "a", highest_order=0).crossmatch(cat(B, "b", highest_order=0), n_neighbors=2, radius_arcsec=R, suffixes=("_a", "_b"), suffix_method="all_columns")
    path = tempfile.mkdtemp(prefix="skygrid-test") + "/links"
    links.to_association(path, catalog_name="links", primary_catalog_dir="a", primary_column_association="id_a", primary_id_column="id", join_catalog_dir="b", join_column_association="id_b", join_id_column="id", separation_column="_dist_arcsec")
    got = {}
    for x in sorted(read_hats(path).df.collect(), key=lambda x: (round(x["_dist_arcsec"], 4), x.id_b)):
        got.setdefault(x.id_a, []).append((x.id_b, round(x["_dist_arcsec"], 4)))
    agree(got, want(A, B, 2))
    matched(links.df)


@case
def left(spark):
    some = B[B.ra < 30]
    out = cat(A, "a").crossmatch(cat(some, "b"), radius_arcsec=R, how="left", suffix_method="all_columns").df
    agree(matched(out), want(A, some, 1), empty=True)
    assert out.where("id_b is null and _dist_arcsec is not null").count() == 0


@case
def partition_scope(spark):
    a, b = cat(A, "a", lowest_order=3, highest_order=3), cat(B, "b", lowest_order=3, highest_order=3)
    pix = lambda c: np.array([x[1] >> 52 for x in sorted(c.df.select("id", "_healpix_29").collect())])
    out = a.crossmatch(b, radius_arcsec=R, n_neighbors=3, scope="partition", suffix_method="all_columns").df
    agree(matched(out), want(A, B, 3, same=pix(a)[:, None] == pix(b)[None]))


@case
def itself(spark):
    b = cat(B, "b")
    out = b.crossmatch(b, radius_arcsec=R, n_neighbors=2, suffix_method="all_columns").df
    agree(matched(out, "id", "id_right"), want(B, B, 2))


@pytest.mark.parametrize("name", CASES)
def test_dense_match(spark, name):
    CASES[name](spark)


def test_nearest_in_clusters():
    """Groups of any density, copies by the thousand, rows without a place."""
    r = np.random.default_rng(5)
    right = np.concatenate([r.normal(0, 1e-9, (400, 3)), r.uniform(-0.1, 0.1, (2000, 3)), np.zeros((3000, 3)), np.full((2, 3), np.nan)])
    right = right[np.lexsort(right.T[::-1])]
    left = np.concatenate([r.uniform(-0.1, 0.1, (300, 3)), r.normal(0, 1e-9, (50, 3)), np.full((1, 3), np.nan)])
    lgroup, rgroup = r.integers(0, 3, len(left)), np.sort(r.integers(0, 2, len(right)))
    for n, chord, low in ((1, 0.05, 0.0), (4, 0.05, 0.02), (2, 1e-9, 0.0)):
        li, ri, d2 = nearest(lgroup, left, rgroup, right, n, chord, low)
        for i in range(len(left)):
            d = ((left[i] - right) ** 2).sum(axis=1)
            near = np.flatnonzero((d < chord**2) & ((d > low**2) | (low == 0)) & (rgroup == lgroup[i]))
            best = near[np.lexsort((near, d[near]))][:n]
            assert ri[li == i].tolist() == best.tolist() or np.allclose(d2[li == i], d[best], rtol=1e-12)


def crowded(n, seed):
    """Many rows to a cell of order 8; the last column runs against the index."""
    r = np.random.default_rng(seed)
    f = pd.DataFrame({"ra": r.uniform(10, 12, n), "dec": r.uniform(0, 2, n)})
    return f.assign(id=r.permutation(n))[["id", "ra", "dec"]]


def asof(spark, way):
    """Ties within a cell go by columns, not by places inside it."""
    a, b = (cat(crowded(n, n), name, lowest_order=1, highest_order=1) for n, name in ((300, "a"), (200, "b")))
    rights = [(x["_healpix_29"] >> 42, x["_healpix_29"] >> 56, x.id) for x in b.df.collect()]
    want = {}
    for x in a.df.collect():
        h, part = x["_healpix_29"] >> 42, x["_healpix_29"] >> 56
        here = [(p, i) for p, o, i in rights if o == part and (way == "nearest" or (p <= h if way == "backward" else p >= h))]
        keys = {"backward": lambda t: (-t[0], -t[1]), "forward": lambda t: t, "nearest": lambda t: (abs(t[0] - h), t[0] > h, t[1])}
        want[x.id] = min(here, key=keys[way])[1] if here else None
    got = a.merge_asof(b, way, suffix_method="all_columns", order=8).df
    assert {x.id_a: x.id_b for x in got.collect()} == want and any(v is not None for v in want.values())


@pytest.mark.parametrize("way", ["backward", "forward", "nearest"])
def test_asof_at_an_order(spark, way):
    asof(spark, way)


def test_index_order(spark):
    """Ties within a cell go by columns."""
    c = cat(crowded(400, 3), "c")
    rows = sorted((x["_healpix_29"] >> 42, x.id) for x in c.df.collect())
    assert len({p for p, _ in rows}) < 200
    assert c.compute(order=8).id.tolist() == [i for _, i in rows]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_own_algorithm_in_slices(spark, how):
    class Twos(skygrid.AbstractCrossmatchAlgorithm):
        """Every left row with the right rows of its parity."""

        extra_columns = {"gap": "long"}
        left_rows = 70

        def perform_crossmatch(self, left, right):
            assert len(left) <= 70
            li, ri = np.nonzero((left["id_a"].to_numpy()[:, None] % 4) == right["id_b"].to_numpy()[None] % 2)
            return li, ri, pd.DataFrame({"gap": right["id_b"].to_numpy()[ri] - left["id_a"].to_numpy()[li]})

    a, b = cat(A, "a", highest_order=0), cat(B[:200], "b", highest_order=0)
    out = a.crossmatch(b, algorithm=Twos(), how=how, suffix_method="all_columns").df
    want = {(i, j, j - i) for i in A.id for j in B.id[:200] if i % 4 == j % 2}
    want |= {(i, None, None) for i in A.id if i % 4 > 1} if how == "left" else set()
    rows = [(x.id_a, x.id_b, x.gap) for x in out.select("id_a", "id_b", "gap").collect()]
    assert len(rows) == len(want) and set(rows) == want
