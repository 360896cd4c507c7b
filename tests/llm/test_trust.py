import numpy as np
import pytest

from scarpline.llm import url_filter


def power_iteration(good, bad, links, damping=0.85):
    """Trust along the links and distrust against them, as whole matrices, until nothing moves."""
    n = len(good)
    a = np.zeros((n, n))
    for u, v, w in links:
        a[u, v] += w
    forth, back = (np.divide(m, m.sum(1, keepdims=True), out=np.zeros_like(m), where=m.sum(1, keepdims=True) > 0) for m in (a, a.T))
    trust, distrust = np.array(good, float), np.array(bad, float)
    for _ in range(2000):
        trust, distrust = damping * trust @ forth + (1 - damping) * np.array(good), damping * distrust @ back + (1 - damping) * np.array(bad)
    return trust, distrust


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_equal_power_iteration(spark, seed):
    rng = np.random.default_rng(seed)
    n = 25
    links = sorted({(int(u), int(v)) for u, v in rng.integers(0, n, (60, 2)) if u != v})
    links = [(u, v, int(rng.integers(1, 5))) for u, v in links]
    good, bad = [1.0 if i < 3 else 0.0 for i in range(n)], [1.0 if 3 <= i < 5 else 0.0 for i in range(n)]
    seeds = spark.createDataFrame([(str(i), good[i], bad[i]) for i in range(n)], "host string, good double, bad double")
    edges = spark.createDataFrame([(str(u), str(v), w) for u, v, w in links], "src string, dst string, n long")
    got = {int(r["host"]): r for r in url_filter.spread_trust(seeds, edges, settled=1e-6).collect()}
    trust, distrust = power_iteration(good, bad, links)
    assert sorted(got) == list(range(n))
    for i in range(n):
        assert abs(got[i]["trust"] - trust[i]) < 1e-4 * max(trust[i], 1e-9) + 1e-12
        assert abs(got[i]["distrust"] - distrust[i]) < 1e-4 * max(distrust[i], 1e-9) + 1e-12


def test_a_host_far_from_the_seed_is_judged(spark):
    """A chain of 26 links that ends at a blocked host; 20 rounds or a fixed limit would leave its first hosts out."""
    link = lambda h: f'<a href="http://{h}/">x</a>'
    rows = [(i, f"http://h{i}.net/", link(f"h{i + 1}.net") if i < 25 else link("x.com")) for i in range(26)] + [(26, "http://x.com/de/", None)]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i]["verdict"] == "block" and got[i]["distrust"] > 0 for i in range(27))


def test_what_does_not_settle_is_an_error(spark):
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, good double, bad double")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "src string, dst string, n long")
    with pytest.raises(RuntimeError):
        url_filter.spread_trust(seeds, edges, rounds=1)
