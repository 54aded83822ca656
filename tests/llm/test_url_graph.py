"""Trust and distrust over a long chain of hosts against the converged solution."""

import numpy as np
import pytest

from docsift.llm import url_filter


def test_long_chain(spark):
    links = {f"b{k}.example.com": [] for k in range(10)}
    links["hub.org"] = list(links)
    for k in range(9):
        links[f"c{k}.org"] = [f"c{k - 1}.org" if k else "hub.org"]
    links["c3.org"].append("a.com")
    links["a.com"] = ["c8.org", "hub.org"]
    made = lambda k, host: f'<a href="//{host}/x">' if k % 2 else f"<a href='http://{host}/x'>"
    rows = [(k, f"http://{h}/en/{k}", "".join(made(k + j, x) for j, x in enumerate(out))) for k, (h, out) in enumerate(links.items())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    hosts = list(links)
    hops = np.array([[float(b in links[a]) for b in hosts] for a in hosts])
    want = {}
    for kind, step, seeds in (("trust", hops, ["a.com"]), ("distrust", hops.T, hosts[:10])):
        share = step / np.maximum(step.sum(1, keepdims=True), 1)
        start = np.array([0.15 * (h in seeds) for h in hosts])
        want[kind] = dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - 0.85 * share.T, start), strict=True))
    got = {r.host: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(hosts)
    for h in hosts:
        assert (got[h].trust, got[h].distrust) == (pytest.approx(want["trust"][h], abs=1e-6), pytest.approx(want["distrust"][h], abs=1e-6))
        graph = "block" if want["distrust"][h] >= 0.05 and want["distrust"][h] > want["trust"][h] else "allow"
        assert got[h].verdict == ("allow" if h == "a.com" else "block" if h.startswith("b") else graph)
    assert got["c8.org"].verdict == "block"
