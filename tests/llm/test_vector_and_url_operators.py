import duckdb
import numpy as np
import pandas as pd
import pytest

from formline.llm import url_filter, vector_codes, whitening
from formline.llm.common import ORACLES
from tests.oracle import compare

# --- url filter -------------------------------------------------------------------------------

PAGES = [
    (1, "http://a.net/en/1", '<link rel="canonical" href="https://b.NET/es/x/../1?k=1&amp;j=2#f">'), (2, "https://b.net/es/1?k=1&j=2", None),
    (3, "http://c.org/x/y", "<LINK href=/z rel=canonical>"), (4, "http://c.org/z", '<meta http-equiv="Refresh" content="0; url=//d.net/fr/1">'),
    (5, "http://e.org/a#b", '<!-- <link rel="canonical" href="http://net/es/"> --><script>"<link rel=canonical href=http://net/es/>"</script>'),
    (6, None, "<link rel=canonical href=http://net/es/>"), (7, "nothing", ""), (8, "ftp://f.org?x", "<link rel=\"alternate canonical\" href='?q'>"),
    (9, "http://g.org/p/q", '<link rel="canonical" href="../es.html">'), (10, "http://g.org/es.html", '<link rel=canonical href="http://www.example.com/en/">'),
    (11, "http://h.org/1", '<link rel=canonical href="http://www.example.com/en/"><meta http-equiv=refresh content="3;URL=http://net/es/">'),
    (12, "http://net/es/q", '<link rel="canonical" href="http://x.com/">'), (12, "http://i.org/", '<link rel="canonical" href="mailto:x"><link rel=canonical href="http://net/es/2">'),
    (13, "HTTP://J.org", '<link rel="canonical" href="http://net/es/2">'), (14, "http://j.org/#x", None), (14, "http://j.org/#x", None),
    (15, "http://K.org/./a/./", '<link rel="canonical" href="http://net/es/2">'), (16, "http://k.org/a/", None), (None, "https://blog.Example.com/en/1?q", "x"),
    (17, "http://" + "l" * 50000 + ".org/", "<p>canonical" + "y" * 200000),
]
BLOCKED = {1, 2, 3, 4, 12, 13, 14, 15, 16, None}


@pytest.fixture(scope="module")
def odd_pages(spark):
    return spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, host string, verdict string")


def test_aliases_share_blocks_and_allows_win(odd_pages):
    out = url_filter.judged(odd_pages).collect()
    assert len(out) == len(PAGES)
    blocked = [r.page_id for r in out if r.verdict == "block"]
    assert sorted(blocked, key=str) == sorted([1, 2, 3, 4, 12, 13, 14, 14, 15, 16, None], key=str)
    assert {r.verdict for r in out} == {"allow", "block"}
    assert {(r.host, r.path) for r in out if r.page_id in (6, 7)} == {("", "")}


def test_odd_pages_against_sql(odd_pages):
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    assert compare(url_filter.judged(odd_pages), con, ORACLES["op11_url_filter"]) is None


def test_redirect_table_chains_and_a_hot_target(spark):
    n = 3000  # a third of all pages redirect to one url, the rest are one long chain and single pages
    pages = spark.range(n).selectExpr("id as page_id", "concat('http://p', id, '.org/') as url")
    hot = spark.range(n // 3).selectExpr("concat('http://p', id, '.org/') as source", "'http://hub.net/fr/x' as target")
    chain = spark.range(n // 3, n // 3 + 40).selectExpr("concat('http://p', id, '.org/') as source", "concat('http://p', id + 1, '.org/#f') as target")
    end = spark.createDataFrame([(f"http://p{n // 3 + 40}.org", "http://net/es/"), (None, "http://net/es/"), ("http://p2000.org/", None), ("", "")], "source string, target string")
    out = url_filter.judged(pages, redirects=hot.union(chain).union(end))
    assert sorted(r.page_id for r in out.filter("verdict = 'block'").collect()) == list(range(n // 3 + 41))
    allowed = url_filter.judged(pages, redirects=hot.union(chain).union(end).union(spark.createDataFrame([("http://p5.org/", "https://a.com/")], "source string, target string")))
    assert sorted(r.page_id for r in allowed.filter("verdict = 'block'").collect()) == list(range(n // 3, n // 3 + 41))


def test_url_filter_runs_no_python_and_keeps_empty_tables(spark, folder, odd_pages):
    assert url_filter.judged(odd_pages.limit(0)).collect() == []
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    for df in (url_filter.judged(pages), url_filter.page_links(pages), url_filter.alias_verdicts(url_filter.page_links(pages), url_filter.RULES)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# --- vectors ----------------------------------------------------------------------------------

def odd_vectors(spark, dim, n=40):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim) / 4], i % 3) for i in range(n)]
    rows += [(5, rows[5][1], 1), (None, rows[7][1], None), (-3, rows[9][1], None), (100, None, 1), (101, [], 1), (102, [1.0] * (dim - 1) + [float("nan")], 0),
             (103, [float("inf")] + [0.0] * (dim - 1), 0), (104, [None] + [0.5] * (dim - 1), 2), (105, [1.0, 2.0], 2), (106, [0.0] * dim, 2)]
    kept = [(v, x, k) for v, x, k in rows if x and len(x) == dim and all(c is not None and np.isfinite(c) for c in x)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<float>, label int, x string, code string")
    return df, kept


def lloyd(kept, parts, entries, rounds):
    """Full scans in plain numpy."""
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    x = np.floor(1024 * np.array([k[1] for k in kept])).astype(np.int64)
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)
    books = x[order[:entries]].copy()
    for k in range(rounds + 1):
        d = ((x[:, None] - books[None]) ** 2).sum(axis=3)
        code = d.argmin(axis=1)
        if k < rounds:
            for p in range(parts):
                for e in np.unique(code[:, p]):
                    books[e, p] = x[code[:, p] == e, p].sum(axis=0) // (code[:, p] == e).sum()
    return code, d.min(axis=1), books.transpose(1, 0, 2)


@pytest.mark.parametrize("dim,entries,rounds", [(8, 6, 4), (10, 64, 3), (4, 1, 2), (3, 5, 0)])
def test_vector_codes_equal_full_scans(spark, dim, entries, rounds):
    df, kept = odd_vectors(spark, dim)
    found, books = vector_codes.vector_codes(df, 4, entries, rounds)
    code, dist, want = lloyd(kept, 4, entries, rounds)
    assert np.array_equal(books, want)
    got = sorted((str(r.vec_id), tuple(r.code), tuple(r.dist)) for r in found.collect())
    assert got == sorted((str(k[0]), tuple(map(int, c)), tuple(map(int, d))) for k, c, d in zip(kept, code, dist))


def test_reassign_compares_moved_entries_only_and_keeps_ties():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-3, 4, size=(500, 2)), rng.integers(-3, 4, size=(30, 2))  # small numbers: many ties
    every = np.ones(30, dtype=bool)
    code, dist = vector_codes.reassign(x, book, np.zeros(500, dtype=np.int64), np.zeros(500, dtype=np.int64), every)
    for moved_share in (0.0, 0.1, 0.5):
        new = book.copy()
        some = rng.random(30) < moved_share
        new[some] += rng.integers(-1, 2, size=(int(some.sum()), 2))
        moved = (new != book).any(axis=1)
        got = vector_codes.reassign(x, new, code, dist, moved)
        d = ((x[:, None] - new[None]) ** 2).sum(axis=2)
        assert np.array_equal(got[0], d.argmin(axis=1)) and np.array_equal(got[1], d.min(axis=1))


def test_distances_stay_exact_for_large_numbers():
    x = np.array([[vector_codes.LARGEST, -vector_codes.LARGEST, 1, 0]])
    book = np.array([[-vector_codes.LARGEST, vector_codes.LARGEST, 0, 1], [vector_codes.LARGEST, -vector_codes.LARGEST, 0, 0]])
    assert vector_codes.distances(x, book).tolist() == [[8 * vector_codes.LARGEST ** 2 + 2, 1]]


def test_vector_operators_on_empty_tables(spark):
    none = odd_vectors(spark, 4)[0].limit(0)
    assert vector_codes.vector_codes(none)[0].collect() == [] and whitening.whitened(none).collect() == []


@pytest.mark.parametrize("bits", [3, 20, 33, 40])
def test_products_are_exact(bits):
    y = np.random.default_rng(bits).integers(-(1 << bits), (1 << bits) + 1, size=(50, 3))
    assert (whitening.products(y) == y.astype(object).T @ y.astype(object)).all()


def test_characteristic_polynomial_by_trace_formula(spark):
    a = np.random.default_rng(5).integers(-10 ** 6, 10 ** 6, size=(9, 6)).astype(object)
    for m in (a.T @ a, np.zeros((3, 3), dtype=object), np.diag([7, 0, 7, 2]).astype(object)):
        want, power = [1], np.identity(len(m), dtype=int).astype(object)
        for k in range(1, len(m) + 1):  # Faddeev and LeVerrier
            power = m @ power
            c = -sum(power[i, i] for i in range(len(m))) // k
            want.append(c)
            power = power + c * np.identity(len(m), dtype=int).astype(object)
        assert whitening.characteristic(spark, m) == want


def test_multiple_and_zero_roots(spark):
    m = np.diag([7, 0, 7, 2]).astype(object)
    basis, values = whitening.spectrum(spark, m, 8)
    assert [round(float(v), 12) for v in values] == [7, 7, 2]
    assert np.allclose(basis.T @ basis, np.identity(3), atol=1e-15) and np.allclose(m.astype(float) @ basis, basis * [7, 7, 2])
    wide = [((lo + hi) / 2) / 2 ** s for lo, hi, s in whitening.leading_roots([1, -(10 ** 12) - 1, 10 ** 12], 2)]  # 10 ** 12 and 1
    assert wide == [10 ** 12, 1]


def test_whitening_against_numpy(spark):
    df, kept = odd_vectors(spark, 6)
    out = whitening.whitened(df, 4).collect()
    x = np.floor(1024 * np.array([k[1] for k in kept])).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    want = c @ u / np.sqrt(e)
    assert len(out) == 4 * n and {r.n for r in out} == {n}
    assert sorted(r.deviation for r in out) == sorted(4 * ((n * x - sums) ** 2).sum(axis=1).tolist())
    for k in range(4):
        got = sorted(r.whitened for r in out if r.component == k + 1)
        assert np.allclose(got, np.sort(want[:, k]), atol=1e-9) or np.allclose(got, np.sort(-want[:, k]), atol=1e-9)
        assert np.allclose([r.explained for r in out if r.component == k + 1], e[k] / np.trace(c.T @ c / n), rtol=1e-12)
    assert max(r.identity_error for r in out) < 1e-12


def test_whitening_of_few_or_equal_vectors(spark):
    few = spark.createDataFrame([(1, [0.0, 1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    out = whitening.whitened(few).collect()  # rank one
    assert sorted((r.vec_id, r.component) for r in out) == [(1, 1), (2, 1), (3, 1)] and abs(out[0].explained - 1) < 1e-15
    assert whitening.whitened(few.filter("vec_id > 1")).collect() == []
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whitened(huge).collect()] == [None, None]
