"""Queries without SQL: their own results against plain Python over the same tables."""

import collections

import pytest

from lodestrata.plans import catalog


def test_events_cluster_as_in_a_plain_loop(spark, sf_dir):
    groups = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id", "ts").collect():
        groups[r["user_id"], r["event_type"]].append((r["ts"], r["event_id"]))
    want = set()
    for (user, kind), claims in groups.items():
        events = []  # [time, first claim, claims]
        for at, claim in sorted(claims):
            near = [e for e in events if abs((e[0] - at).total_seconds()) <= 2 * 86400]
            if near:
                mine = min(near, key=lambda e: abs((e[0] - at).total_seconds()))
                mine[0] = min(mine[0], at)
                mine[2].append(claim)
            else:
                events.append([at, claim, [claim]])
        want |= {(user, kind, claim, e[1]) for e in events for claim in e[2]}
    got = catalog.QUERIES["join18_cluster_events"](spark, sf_dir).collect()
    assert {(r["user_id"], r["event_type"], r["event_id"], r["event"]) for r in got} == want and len(got) == len(want)


def longer(found, edges):
    """Whether a matching has a path of exchanges from a free row to a free column."""
    owner, near = {c: r for r, c in found}, collections.defaultdict(set)
    for r, c in edges:
        near[r].add(c)
    taken = {r for r, _ in found}
    todo, seen = [r for r in near if r not in taken], set()
    while todo:
        for c in near[todo.pop()] - seen:
            if c not in owner:
                return True
            seen.add(c)
            todo.append(owner[c])
    return False


@pytest.mark.parametrize("name", ("join20_bipartite_matching", "gr6_maximum_matching"))
def test_matchings_are_maximum(spark, sf_dir, name):
    if name.startswith("join20"):
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_partkey").collect()
        edges = {(g, x % 50, y % 40) for g, x, y in rows if x % 50 != y % 40 and (x % 50 * 7 + y % 40) % 9 == 0}
    else:
        rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus", "o_custkey", "o_orderkey").collect()
        edges = {(g, x % 30, y % 25) for g, x, y in rows if (x % 30 + y % 25) % 4 == 0}
    got = collections.defaultdict(list)
    for g, left, right in catalog.QUERIES[name](spark, sf_dir).collect():
        got[g].append((left, right))
    by_group = collections.defaultdict(set)
    for g, left, right in edges:
        by_group[g].add((left, right))
    for g, pairs in by_group.items():
        assert set(got[g]) <= pairs and len({x for x, _ in got[g]}) == len({y for _, y in got[g]}) == len(got[g])
        assert not longer(got[g], pairs)


def test_themes_follow_the_first_leader(spark, sf_dir):
    groups = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_partkey", "p_name").collect():
        groups[r["p_brand"]].append((r["p_partkey"], set(r["p_name"].split(" "))))
    want = {}
    for items in groups.values():
        leaders = []
        for key, words in sorted(items, key=lambda x: x[0]):
            fit = [k for k, w in leaders if 2 * len(words & w) >= min(len(words), len(w))]
            want[key] = fit[0] if fit else key
            if not fit:
                leaders.append((key, words))
    got = catalog.QUERIES["ext26_greedy_themes"](spark, sf_dir).collect()
    assert {r["p_partkey"]: r["leader"] for r in got} == want


def test_components_of_the_whole_table(spark, sf_dir):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = catalog.QUERIES["gr1_components"](spark, sf_dir).collect()
    assert {r["node"]: r["component"] for r in got} == {n: find(n) for n in list(parent)}


def test_full_urls(spark, sf_dir):
    import posixpath
    from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit

    tracking = "fbclid gclid mc_cid mc_eid spm from from_source ref referrer source".split()

    def plain(url):
        u = urlsplit(url)
        path = posixpath.normpath(u.path or "/").replace("//", "/")
        path += "/" if u.path.endswith("/") and path != "/" else ""
        items = sorted(i for i in parse_qsl(u.query, keep_blank_values=True) if i[0].lower() not in tracking and not i[0].lower().startswith("utm_"))
        return f"{u.scheme.lower()}://{u.netloc.lower()}{quote(unquote(path), safe='/:@!$&()*+,;=-._~' + chr(39))}" + (f"?{urlencode(items)}" if items else "")

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()
    got = {r["page_id"]: r["url"] for r in catalog.QUERIES["str2_normalize_url_full"](spark, sf_dir).collect()}
    assert got == {r["page_id"]: plain(r["url"]) for r in pages}
