import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from pagelode.llm import radix_percentiles as R

DDL = "perf_id bigint, site_id string, page_type string, load_ms bigint, html_kb double, ttfb_ms bigint, measured_at timestamp, metric string"


@settings(max_examples=200, deadline=None)
@given(st.floats(allow_nan=False), st.floats(allow_nan=False))
def test_keys_keep_order(a, b):
    ka, kb = R.to_key(np.array([a, b]))
    assert (ka < kb) == (a < b) and (ka == kb) == (a == b)
    assert R.from_key(R.to_key(np.array([a])))[0] == a


def brute(data, percents=R.PERCENTS):
    groups, seen = {}, set()
    for p, s, t, *values in data:
        if p in seen:
            continue
        seen.add(p)
        for m, v in zip(R.METRICS, values, strict=True):
            if v is not None and np.isfinite(v) and v >= 0:
                groups.setdefault((s, t, m), []).append(float(v))
    return {(*g, p): (len(v), sorted(v)[-(-len(v) * p // 100) - 1]) for g, v in groups.items() for p in percents}


def frame(spark, data):
    import datetime

    return spark.createDataFrame([(*r, datetime.datetime(2024, 1, 1 + r[0] % 20), "clash") for r in data], DDL)


def test_against_sorting(spark):
    rng = np.random.default_rng(2)
    data = []
    for i in range(900):
        site, kind = ("hot", "a") if i % 2 else (f"s{i % 7}", None if i % 3 else "b")
        kb = [1.0 + (i % 50) * 1e-12, float("nan"), -1.0, 0.0, None, float("inf"), float(rng.lognormal(3, 1))][i % 7]
        data.append((i, site, kind, int(rng.integers(0, 5000)) if i % 5 else None, kb, 7))
    data += data[:40] + [(5000, None, None, 1, 1.0, 1)]
    got = {tuple(r)[:4]: tuple(r)[4:] for r in R.exact_percentiles(frame(spark, data)).collect()}
    assert got == brute(data)


def test_digests_add_up(spark):
    rng = np.random.default_rng(3)
    data = [(i, "s", "a", int(rng.integers(1, 9000)), float(rng.lognormal(2, 2)), 3) for i in range(500)]
    whole = R.digest(frame(spark, data))
    halves = R.digest(frame(spark, data[:250])).unionByName(R.digest(frame(spark, data[250:])))
    a, b = rows(R.merged_percentiles(whole)), rows(R.merged_percentiles(halves))
    assert a == b
    exact = brute(data)
    assert all(abs(v - exact[(s, t, m, p)][1]) <= exact[(s, t, m, p)][1] * 2 ** -(R.DIGEST_BITS - 12) for s, t, m, p, _, v in a)


def test_no_rows(spark):
    assert rows(R.exact_percentiles(frame(spark, []))) == []
    assert rows(R.merged_percentiles(R.digest(frame(spark, [])))) == []
