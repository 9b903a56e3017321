"""Grids, maps and runs against numpy and the golden sums of FIXTURES.md."""

import numpy as np
import pytest

from tessella import Domain, GridSession, cast, f32, map_reduce, reduce_grid, run, smap, smap_black, smap_red, smap_redblack, when
from tessella.functions.kernel import log
from tessella.queries import cube, inner, star, summing, whole

N = 32
CUBE = (N, N, N)
STRATEGIES = [None, "scatter", "tile"]


def total(grid):
    return int(grid.to_numpy().sum(dtype="float64"))


def one_map(gs, offsets, domain, periodic=False, strategy=None, dims=CUBE):
    g, out = gs.iota(dims), gs.iota(dims)
    run(smap(summing(offsets, periodic), domain, g, out), strategy=strategy)
    return out


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize(
    ("offsets", "width", "periodic", "golden", "cell", "value"),
    [
        (star(3), 1, False, 3190981528, (7, 6, 5), 37233),
        (star(3), 0, True, 3757981696, (1, 1, 1), 7399),
        (cube(3), 1, False, 12038071528, (7, 6, 5), 143613),
        ([(0, 0, 0), (1, 1, 1), (-2, -2, -2)], 2, False, 1232952448, (7, 6, 5), 14900),
        ([(0, 0, 0), (2, 0, 0), (-2, 0, 0)], 2, False, 1256155712, (1, 1, 1), 1057),
        ([(0, 0, 0), (0, 0, -1), (0, 0, 1)], 0, True, 1610563584, (1, 1, 1), 3171),
    ],
)
def test_goldens_hold_for_every_strategy(gs, strategy, offsets, width, periodic, golden, cell, value):
    out = one_map(gs, offsets, inner(CUBE, width), periodic, strategy)
    got = out.to_numpy()
    assert int(got.sum(dtype="float64")) == golden
    assert got[cell] == value


def test_one_dimension(gs):
    got = one_map(gs, [(-1,), (0,), (1,)], Domain((1, 1023)), dims=(1024,)).to_numpy()
    assert got.sum(dtype="float64") == 1569282 and got[1] == 3 and got[500] == 1500


@pytest.mark.parametrize("strategy", [None, "tile"])
@pytest.mark.parametrize(("periodic", "golden", "cells"), [(False, 10887949828, {(1, 1, 1): 32767, (2, 1, 1): 7406}), (True, 13421363200, {(1, 1, 1): 79275})])
def test_red_black(gs, strategy, periodic, golden, cells):
    g = gs.iota(CUBE)
    kernel = summing(star(3), periodic)
    run(smap_redblack(lambda x, y, z, g: kernel(x, y, z, g, g), whole(CUBE) if periodic else inner(CUBE), g), strategy=strategy)
    got = g.to_numpy()
    assert int(got.sum(dtype="float64")) == golden
    assert all(got[c] == v for c, v in cells.items())


def test_separate_colors_equal_both(gs):
    a, b = gs.iota((8, 8)), gs.iota((8, 8))
    kernel = summing(star(2))
    f = lambda x, y, g: kernel(x, y, g, g)
    run(smap_redblack(f, inner((8, 8)), a))
    run(smap_red(f, inner((8, 8)), b), smap_black(f, inner((8, 8)), b))
    assert (a.to_numpy() == b.to_numpy()).all()


def test_asymmetric_periodic(gs):
    g, out = gs.iota(CUBE), gs.iota(CUBE)
    run(smap(lambda x, y, z, g, o: o.emit(g[x, y, z] + g[x - 1, y, z] + g.periodic[x + 2, y, z]), inner(CUBE, 2), g, out))
    got = out.to_numpy()
    assert got.sum(dtype="float64") == 1256177664 and got[2, 2, 2] == 6343 and got[29, 2, 2] == 6424


@pytest.mark.parametrize(("n", "golden"), [(8, 915712), (32, 3757981696)])
def test_clamped_edges(gs, n, golden):
    def kernel(x, y, z, g, out):
        c = g[x, y, z]
        sides = [
            when(x == 0, c, g[x - 1, y, z]), when(x == n - 1, c, g[x + 1, y, z]), when(y == 0, c, g[x, y - 1, z]),
            when(y == n - 1, c, g[x, y + 1, z]), when(z == 0, c, g[x, y, z - 1]), when(z == n - 1, c, g[x, y, z + 1]),
        ]
        out.emit(sum(sides, c))

    g, out = gs.iota((n,) * 3), gs.zeros((n,) * 3)
    run(smap(kernel, whole((n,) * 3), g, out))
    assert total(out) == golden


def test_conditional_reads(gs):
    def kernel(x, y, z, g, out):
        c = g[x, y, z]
        left = when(x > 0, g[x - 1, y, z], f32(0))
        value = left + when(x > 0, g[x - 1, y, z], c) + when(x > 0, g[x - 1, y, z], c)
        value = value + when((x > 0) & (x < N - 1), g[x - 1, y, z] + g[x + 1, y, z], c) + when(x % 2 == 0, c, f32(0))
        out.emit(c + value)

    g, out = gs.iota(CUBE), gs.zeros(CUBE)
    run(smap(kernel, whole(CUBE), g, out))
    got = out.to_numpy()
    assert total(out) == 3439136768 and got[0, 0, 0] == 0 and got[31, 0, 0] == 152 and got[7, 6, 5] == 31911


def test_coefficients_of_lower_rank(gs):
    dims = (32, 34, 32)
    g, out = gs.iota(dims), gs.iota(dims)
    i = gs.from_memory([1 + k % 2 for k in range(32)], (32,))
    j = gs.from_memory([1 + k % 2 for k in range(34 * 32)], (34, 32))

    def kernel(x, y, z, g, o, i, j):
        o.emit(
            g[x, y, z] + g[x - 1, y, z] * i[x - 1] + g[x + 1, y, z] * i[x + 1] + g[x, y - 1, z] * j[y - 1, z]
            + g[x, y + 1, z] * j[y + 1, z] + g[x, y, z - 1] * j[y, z - 1] + g[x, y, z + 1] * j[y, z + 1]
        )

    run(smap(kernel, Domain((1, 31), (1, 33), (1, 31)), g, out, i, j))
    got = out.to_numpy()
    assert int(got.sum(dtype="float64")) == 5118097920 and got[1, 1, 1] == 10089 and got[7, 6, 5] == 50751


def test_mixed_types(gs):
    g, out = gs.iota(CUBE), gs.zeros(CUBE, "double")
    coeff = gs.from_memory([k % 10 for k in range(N**3)], CUBE, "int")

    def kernel(x, y, z, g, o, c):
        o.emit(sum((cast(g[tuple(a + b for a, b in zip((x, y, z), off, strict=True))], "double") for off in star(3)), cast(0, "double")) * c[x, y, z])

    run(smap(kernel, inner(CUBE), g, out, coeff))
    got = out.to_numpy()
    assert int(got.sum()) == 13934119500 and got[1, 1, 1] == 51793 and got[7, 6, 5] == 335097


def test_reflection_and_identity_pair(gs):
    g, out = gs.iota((8, 8, 8)), gs.zeros((8, 8, 8))
    run(smap(lambda x, y, z, g, o: o.emit(g[8 - x - 1, y, z]), whole((8, 8, 8)), g, out))
    assert (out.to_numpy() == g.to_numpy()[::-1]).all()
    before = g.to_numpy()
    double = lambda x, y, z, a, b: b.emit(a[x, y, z] * f32(2))
    halve = lambda x, y, z, a, b: b.emit(a[x, y, z] / f32(2))
    run(smap(double, whole((8, 8, 8)), g, out), smap(halve, whole((8, 8, 8)), out, g))
    assert (g.to_numpy() == before).all()


@pytest.mark.parametrize(("strategy", "per"), [(None, 1), ("tile", 1), ("tile", 4)])
def test_ping_pong_matches_numpy(gs, strategy, per):
    dims, offsets = (12, 11, 10), star(3)
    start = np.random.default_rng(0).integers(0, 9, dims).astype("float64")
    a, b = gs.from_numpy(start), gs.from_numpy(start)
    kernel = summing(offsets)
    run(smap(kernel, inner(dims), a, b), smap(kernel, inner(dims), b, a), iters=3, strategy=strategy, steps_per_shuffle=per, tile=(5, 4, 10))
    p, q = start.copy(), start.copy()
    for _ in range(3):
        for s, t in ((p, q), (q, p)):
            core = sum(s[tuple(slice(1 + o, n - 1 + o) for o, n in zip(off, dims, strict=True))] for off in offsets)
            t[1:-1, 1:-1, 1:-1] = core
    assert (a.to_numpy() == p).all()


def test_reductions(gs):
    g = gs.iota((16, 16, 16), "float")
    assert reduce_grid(g, "sum") == 8386560
    assert reduce_grid(gs.iota((4, 4, 4)), "max") == 63
    assert reduce_grid(gs.iota((8, 8, 8), start=10), "min") == 10
    powers = gs.from_numpy(np.full((4, 4, 4), 1.1, "float32"))
    assert reduce_grid(powers, "prod") == pytest.approx(445.79202, rel=1e-5)
    assert reduce_grid(gs.from_numpy(-np.arange(1, 9, dtype="float32")), "max") == -1
    with pytest.raises(ValueError, match="member"):
        reduce_grid(gs.zeros((3,), {"p": "double"}), "sum")


def test_reductions_after_runs(gs):
    c, d = gs.iota((32, 32), "int"), gs.iota((32, 32), "int")
    kernel = summing(cube(2))
    run(smap(kernel, inner((32, 32)), c, d), smap(kernel, inner((32, 32)), d, c))
    assert reduce_grid(c, "sum") == 35895024


def test_integer_sums_wrap_as_asked(gs):
    n = (16, 16, 16)
    a, b = gs.iota(n, "int"), gs.iota(n, "int")
    kernel = summing(cube(3))
    run(smap(kernel, inner(n), a, b))
    assert reduce_grid(b, "sum") == 154463400
    run(smap(kernel, inner(n), b, a))
    assert reduce_grid(a, "sum") == 3561503400
    assert reduce_grid(a, "sum", overflow="wrap32") == -733463896


def test_int_cells_wrap_like_32_bits(gs):
    g = gs.from_numpy(np.asarray([2**31 - 1, -(2**31), 5], "int32"))
    run(smap(lambda x, g: g.emit(g[x] * 2 + 1), Domain((0, 3)), g))
    assert g.to_numpy().tolist() == [-1, 1, 11]


def test_division_follows_c(gs):
    a = gs.from_numpy(np.asarray([-7, 7, -8], "int32"))
    f = gs.from_numpy(np.asarray([1, 0, -1], "float32"))
    q, r = gs.zeros((3,), "int"), gs.zeros((3,), "int")
    d = gs.zeros((3,), "float")
    run(smap(lambda x, a, q, r: (q.emit(a[x] / 2), r.emit(a[x] % 3))[2:] or None, Domain((0, 3)), a, q, r))
    run(smap(lambda x, f, d: d.emit(f[x] / f32(0)), Domain((0, 3)), f, d))
    assert q.to_numpy().tolist() == [-3, 3, -4] and r.to_numpy().tolist() == [-1, 1, -2]
    got = d.to_numpy()
    assert got[0] == np.inf and np.isnan(got[1]) and got[2] == -np.inf


def test_structs_and_arrays(gs):
    values = {"p": np.arange(12, dtype="float32").reshape(4, 3), "q": np.ones((4, 3), "float32")}
    g = gs.from_numpy(values)
    run(smap(lambda x, y, g: g.q.emit(g[x, y].p + g.periodic[x + 1, y].p), whole((4, 3)), g))
    got = g.to_numpy()
    assert (got["p"] == values["p"]).all() and (got["q"] == values["p"] + np.roll(values["p"], -1, 0)).all()
    a = gs.zeros((4, 3), {"m": ("float", 2, 3)})
    run(smap(lambda x, y, a: a.m[1][2].emit(cast(x * 10 + y, "float")), whole((4, 3)), a))
    m = a.to_numpy()["m"]
    assert m[3, 2, 1, 2] == 32 and m.sum() == m[:, :, 1, 2].sum()


def test_points_and_layout(gs):
    g = gs.from_memory(range(6), (3, 2), "int")
    assert g.get(1, 1) == 4
    g.set(1, 1, 40)
    g.set_many([((0, 0), 7), ((0, 0), 8)])
    assert g.to_numpy().tolist() == [[8, 3], [1, 40], [2, 5]]
    assert g.to_table().orderBy("id").toPandas()["v"].tolist() == [8, 1, 2, 3, 40, 5]
    with pytest.raises(IndexError):
        g.get(3, 0)
    assert g.checked() is g


def test_parquet_round_trip(gs, tmp_path):
    g = gs.iota((5, 4), "double")
    g.write_parquet(str(tmp_path / "g"))
    assert (gs.read_parquet(str(tmp_path / "g"), (5, 4), "double").to_numpy() == g.to_numpy()).all()


def test_bad_kernels_are_refused(gs):
    g, line = gs.iota((4, 4)), gs.iota((4,))
    box = whole((4, 4))
    with pytest.raises(IndexError, match="guard"):
        smap(lambda x, y, g: g.emit(g[x + 1, y]), box, g)
    with pytest.raises(TypeError, match="traced"):
        smap(lambda x, y, g: g.emit(g[x, y]) if g[x, y] > 0 else None, box, g)
    with pytest.raises(ValueError, match="rank"):
        smap(lambda x, y, a: a.emit(x), box, line)
    with pytest.raises(TypeError, match="index"):
        smap(lambda x, y, g: g.emit(g[x + y, y]), box, g)
    with pytest.raises(ValueError, match="after it was emitted"):
        smap(lambda x, y, g: (g.emit(1), g.emit(g[x, y] + 1))[2:] or None, box, g)
    with pytest.raises(ValueError):
        GridSession(gs.spark, (2, 2)).zeros((3, 3))
    with pytest.raises(ValueError):
        gs.zeros((2,), {"p": "int"})


def test_map_reduce(gs):
    g = gs.iota((6, 5), "long")
    got = map_reduce("sum", lambda x, y, g: (g[x + 1, y] - g[x, y]) * y, Domain((0, 5), (0, 5)), g)
    assert got == 5 * (0 + 1 + 2 + 3 + 4)


def test_plans(gs):
    g, out = gs.iota((64, 64)), gs.iota((64, 64))
    run(smap(lambda x, y, g, o: o.emit(g[x, y]), whole((64, 64)), g, g))
    assert "Exchange" not in g.frame._jdf.queryExecution().executedPlan().toString()
    run(smap(summing(star(2)), inner((64, 64)), g, out))
    assert out.frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_settings_and_trials(gs, tmp_path):
    from tessella.operators.tune import Settings, patterns, tuned

    own = Settings("tile", 2, (8, 8))
    own.save(str(tmp_path / "run.json"))
    assert Settings.load(str(tmp_path / "run.json")) == own
    with pytest.raises(ValueError, match="unknown"):
        Settings.of({"speed": 1})
    n = (16, 16)
    a, b = gs.iota(n, "long"), gs.iota(n, "long")
    maps = [smap(summing(star(2)), inner(n), a, b), smap(summing(star(2)), inner(n), b, a)]
    every = patterns(*maps, steps=(2,), edges=(8,))
    before = a.to_numpy()
    best, seconds = tuned(*maps, settings=[*every, Settings("tile", 40, (8, 8))], iters=1)
    assert best in seconds and len(seconds) >= len(every) and (a.to_numpy() == before).all()
    found = []
    for choice in every:
        c, d = gs.iota(n, "long"), gs.iota(n, "long")
        choice.run(smap(summing(star(2)), inner(n), c, d), smap(summing(star(2)), inner(n), d, c), iters=2)
        found.append(c.to_numpy())
    assert all((f == found[0]).all() for f in found)


def test_strategies_agree_where_c_is_open(gs):
    """Overflow, division by zero, NaN and casts: one meaning map by map and on tiles."""
    v = np.asarray([2**62, -(2**63), 2**63 - 1, 0, 7, -7], "int64")
    f = np.asarray([np.nan, np.inf, -np.inf, 0.0, -1.0, 1e300])

    def whole_numbers(x, a, out):
        out.emit(a[x] * 4 + (2**63 - 1) + a[x] / (a[x] % 2) + a[x] % (a[x] - 7))

    def floats(x, f, o, w):
        o.emit(when(f[x] != f[x], 1.5, log(f[x])) + when(f[x] < 5.0, 1.0, 0.0) + when(f[x] >= 0.0, 10.0, 0.0))
        w.emit(cast(f[x], "int"))

    seen = []
    for way in ("map", "tile"):
        a, out = gs.from_numpy(v), gs.zeros((6,), "long")
        g, o, w = gs.from_numpy(f), gs.zeros((6,), "double"), gs.zeros((6,), "int")
        run(smap(whole_numbers, Domain((0, 6)), a, out), strategy=way, tile=(4,))
        run(smap(floats, Domain((0, 6)), g, o, w), strategy=way, tile=(4,))
        seen.append((out.to_numpy().tolist(), o.to_numpy().astype(str).tolist(), w.to_numpy().tolist()))
    assert seen[0] == seen[1]
    assert np.isnan(float(seen[0][1][4])) and seen[0][1][0] == "1.5" and seen[0][2][:2] == [0, -1]


def test_saved_grids_blocks_and_writes(gs):
    g = gs.iota((7, 5), "long")
    for i in range(20):
        g.set(i % 7, i % 5, -i)
    want = np.arange(35).reshape(5, 7).T.copy()
    for i in range(20):
        want[i % 7, i % 5] = -i
    assert (g.to_numpy() == want).all()
    assert g.frame._jdf.queryExecution().logical().toString().count("Join") <= 8
    g.save("test-grid")
    assert (gs.restore("test-grid", (7, 5), "long").to_numpy() == want).all()
    gs.forget("test-grid")
    rows = g.partitioned((3, 2)).collect()
    width = {(0, 0): 2, (0, 1): 2, (0, 2): 3}
    assert {b: len({r.x for r in rows if r.block % 3 == b}) for b in range(3)} == {b: width[(0, b)] for b in range(3)}
    assert {len({r.y for r in rows if r.block // 3 == b}) for b in range(2)} == {2, 3}
