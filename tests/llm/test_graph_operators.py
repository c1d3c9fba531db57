"""Licence scan, host filter, vectors and the pipeline against plain versions."""

import collections
import math
import random
import re

import numpy as np
import pytest

from leafmark.llm import descent, hosts, licences


def test_licences(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    files = [
        ("p/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
        ("p/a/one.py", "# code\nx = 1"),
        ("p/a/two.py", f"# {gpl}\n" + "code\n" * 400),
        ("p/a/b/COPYING.txt", gpl),
        ("p/a/b/three.py", "plain"),
        ("p/a/b/c/four.py", ""),
        ("q/five.py", "nothing"),
        ("q/six.py", None),
        (None, None),
        ("top.txt", "text " * 1000 + "\nReleased under the MIT License."),
        ("q/half", "Licensed under the Apache License, Version 2.0."),
        ("p/a/one.py", "# code\nx = 1"),
    ]
    data = spark.createDataFrame([(i, p, t, "x", 1) for i, (p, t) in enumerate(files)], "id long, path string, text string, licence string, `row` long")
    found = {r["id"]: (r["licence"], r["origin"], r["from_directory"]) for r in licences.scan(data, ["id"]).collect()}
    assert found == {
        0: ("MIT", "text", None), 1: ("MIT", "directory", "p"), 2: ("GPL-3.0", "text", None), 3: ("GPL-3.0", "text", None),
        4: ("GPL-3.0", "directory", "p/a/b"), 5: ("GPL-3.0", "directory", "p/a/b"), 6: ("Apache-2.0", "directory", "q"),
        7: ("Apache-2.0", "directory", "q"), 8: (None, "none", None), 9: ("MIT", "text", None), 10: ("Apache-2.0", "text", None), 11: ("MIT", "directory", "p"),
    }
    assert licences.scan(data.limit(0), ["id"]).count() == 0


def test_licence_similarities_without_anchors(spark, sf_dir):
    """The anchors leave nothing out: all segments of all documents, by a plain cosine."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "cast(doc_id as string) path", "text")
    rows = docs.collect()
    sets = [set(licences.terms_of(t)) for _, t in licences.TEMPLATES]
    df = collections.Counter(t for r in rows for t in set(licences.terms_of(r["text"])) & set().union(*sets))
    idf, other, vectors = licences.template_vectors(len(rows), df)
    want = {}
    for r in rows:
        best = None
        parts = set(r["text"].split("\n")) | {b for b in re.split(r"\n[ \t\r]*\n", r["text"]) if "\n" in b}
        for part in parts:
            w = {t: n * idf.get(t, other) for t, n in collections.Counter(licences.terms_of(part)).items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            for lic, v in vectors:
                cos = round(sum(w.get(t, 0) * x for t, x in v.items()) / norm, 6) if norm else 0
                if cos >= licences.THRESHOLD and (best is None or (-cos, lic) < best):
                    best = (-cos, lic)
        if best:
            want[r["doc_id"]] = best[1]
    found = {r["doc_id"]: r["licence"] for r in licences.scan(docs, ["doc_id"]).where("origin = 'text'").collect()}
    assert found == want and want


def test_licence_notices_of_a_larger_table(spark):
    """Whole lines that are notices give their document a licence, however many documents there are."""
    notices = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "Proprietary",
    }
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("doc_id", "cast(doc_id as string) path", "text")
    want = collections.defaultdict(set)
    for r in docs.where("text is not null").collect():
        for line in set(r["text"].split("\n")) & set(notices):
            want[notices[line]].add(r["doc_id"])
    found = {r["doc_id"]: r["licence"] for r in licences.scan(docs, ["doc_id"]).where("origin = 'text' and similarity = 1").collect()}
    assert want["Proprietary"] and all(found.get(i) in {k for k, v in want.items() if i in v} for v in want.values() for i in v)


def plain_host(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


URLS = [
    "http://A.B.example.ORG/en/12?x=http://y.com/fr/", "https://example.org/es/", "https://x.example.org/es", "http://notorg/", "http://org/x", "ftp://k.com/fr/a#b",
    "http://k.com?fr/", "http://k.com/de/", None, "", "no scheme/org/", "http://", "http://É.com/fr/", "a://b://c.org/", "http://k.com:80/fr/", "http://deep.k.net/x",
]


def test_hosts(spark):
    rng = random.Random(2)
    names = [f"h{i}.net" for i in range(20)] + ["w.good.org", "bad.com", "www.h3.net"]
    pages = [(i, u, None) for i, u in enumerate(URLS)]
    for i in range(100, 260):
        h = rng.choice(names)
        links = "".join(f'<a HREF = "http://{rng.choice(names)}/p">x</a>' for _ in range(rng.randint(0, 4))) + '<a href="/own">'
        pages.append((i, f"http://{h}/{'de' if h == 'bad.com' else 'x'}/", links))
    pages.append(pages[-1])
    data = spark.createDataFrame([(*p, "h", 1) for p in pages], "page_id long, url string, html string, host string, trust int")
    found = hosts.judge(data).collect()
    assert len(found) == len(pages)
    # plain propagation
    weight, known = collections.Counter(), set()
    for _, u, html in pages:
        h = plain_host(u)[0]
        known.add(h)
        targets = {m.lower() for m in re.findall(r'(?i)href\s*=\s*"(?:https?:)?//([^/"]+)', html or "")}
        for t in targets - {h}:
            if h:
                weight[h, t] += 1
                known.add(t)
    family = set()
    for h in known - {""}:
        parts = h.split(".")
        while len(parts) > 2:
            family.add((".".join(parts), ".".join(parts[1:])))
            parts = parts[1:]
    for a, b in family:
        weight[a, b] += 1
        weight[b, a] += 1
    rule = {p[0]: plain_rule(*plain_host(p[1]), hosts.RULES) for p in pages}
    seeds = {"allow": collections.Counter(), "block": collections.Counter()}
    for i, u, _ in pages:
        if rule[i]:
            seeds[rule[i][2]][plain_host(u)[0]] += 1
    ranks = []
    for kind, flip in (("allow", False), ("block", True)):
        edges = {((b, a) if flip else (a, b)): w for (a, b), w in weight.items()}
        out = collections.Counter()
        for (a, _), w in edges.items():
            out[a] += w
        total = sum(seeds[kind].values())
        start = {h: n / total for h, n in seeds[kind].items()}
        state = start
        for _ in range(math.ceil(math.log(hosts.ERROR) / math.log(hosts.DAMPING))):
            new = collections.Counter({h: (1 - hosts.DAMPING) * x for h, x in start.items()})
            for (a, b), w in edges.items():
                new[b] += hosts.DAMPING * state.get(a, 0) * w / out[a]
            state = new
        ranks.append(state)
    n = len({plain_host(u)[0] for _, u, _ in pages} - {""})
    for r in found:
        host, path = plain_host(dict((p[0], p[1]) for p in pages)[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        trust, distrust = ranks[0].get(host, 0.0), ranks[1].get(host, 0.0)
        assert (r["trust"], r["distrust"]) == pytest.approx((trust, distrust))
        by_rule = rule[r["page_id"]]
        want = by_rule[2] if by_rule else "block" if distrust > trust and distrust * n >= hosts.THRESHOLD else "allow"
        assert (r["rule"], r["verdict"]) == (by_rule[0] + by_rule[1] if by_rule else None, want)
    assert {r["verdict"] for r in found if r["rule"] is None} == {"allow", "block"}
    assert hosts.judge(data.limit(0)).count() == 0


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows = [x for x in rng.standard_normal((300, 16))]
    for base in list(rows[:25]):
        rows += [base + 0.1 * rng.standard_normal(16) for _ in range(rng.integers(1, 4))]
    center = rng.standard_normal(16)
    rows += [center + 0.2 * rng.standard_normal(16) for _ in range(60)]  # fuller than a list
    rows += [rows[0]] * 30
    return [(i + 5, [float(np.float32(x)) for x in r], 0) for i, r in enumerate(rows)]


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(descent, "BLOCK", 25)
    rows = vectors()
    odd = [(1, None, 0), (2, [], 0), (3, [0.0] * 16, 0), (4, [float("nan")] + [1.0] * 15, 0), (2000, [None] + [1.0] * 15, 0), (2001, [float("inf")] + [1.0] * 15, 0), (2002, [1.0, 2.0], 0), (None, rows[1][1], 0), (rows[2][0], rows[2][1], 0)]
    data = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, node int").repartition(4)
    found = descent.near_vectors(data).collect()
    assert len(found) == len(rows + odd) and found[0]["recall"] >= descent.TARGET
    fine = rows + odd[-2:]
    x = np.array([r[1] for r in fine])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(fine))
    while (new := np.minimum(label, np.where(linked, label, len(fine)).min(axis=1))).tolist() != label.tolist():
        label = new
    least = {k: min((fine[i][0] for i in np.flatnonzero(label == k) if fine[i][0] is not None)) for k in set(label)}
    want = [(r[0], int(n), least[k]) for r, n, k in zip(fine, linked.sum(axis=1), label)] + [(r[0], 0, r[0]) for r in odd[:-2]]
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in found]
    missed = sum(n for _, n, _ in want) - sum(n for _, n, _ in got)
    assert 0 <= missed <= 0.05 * sum(n for _, n, _ in want)
    assert sum(a == b for a, b in zip(sorted(got, key=str), sorted(want, key=str))) >= 0.98 * len(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    assert descent.near_vectors(data.limit(0)).count() == 0
    assert descent.near_vectors(data.where("vec_id < 5")).count() == 4


def plain_links(rows):
    """Least id of the component and number of links of each vector, by all pairs."""
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(rows))
    while (new := np.minimum(label, np.where(linked, label, len(rows)).min(axis=1))).tolist() != label.tolist():
        label = new
    return sorted((r[0], int(n), rows[k][0]) for r, n, k in zip(rows, linked.sum(axis=1), label, strict=True))


@pytest.mark.parametrize("target", [descent.TARGET, 2.0])
def test_vectors_of_two_tight_groups(spark, monkeypatch, target):
    """Lists are full from inside of each group, but all links across count; a target out of reach ends exactly."""
    monkeypatch.setattr(descent, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = list(rng.standard_normal((60, 16)))
    for turn in (0.0, 0.35):
        centre = np.r_[np.cos(turn), np.sin(turn), np.zeros(14)]
        rows += [centre + 0.03 * rng.standard_normal(16) for _ in range(40)]
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(rows)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = descent.near_vectors(data, target=target).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == plain_links(rows)
    assert {r["component_id"] for r in found if r["vec_id"] >= 60} == {60}


def test_audit_counts_nodes_alike(spark):
    """A large group with all links found does not hide pairs that were missed, nor do copies."""
    rows = [(i, [1.0, 0.001 * i, 0.0, 0.0, 0.0], 100) for i in range(50)]
    rows += [(50, [0.0, 0.0, 1.0, 0.0, 0.0], 1), (51, [0.0, 0.0, 1.0, 0.1, 0.0], 1), (52, [0.0, 0.0, 0.0, 0.0, 1.0], 1)]
    nodes = spark.createDataFrame(rows, "node long, vector array<double>, copies long")
    counts = spark.createDataFrame([(i, 4900, 49, True) for i in range(50)], "node long, n long, m long, full boolean")
    assert descent.audit(nodes, counts, 0.9) == 0.0
    pair = spark.createDataFrame([(50, 1, 1, False)], counts.schema)
    assert descent.audit(nodes, counts.unionByName(pair), 0.9) == 0.5
    assert descent.audit(nodes.where("node < 50"), counts, 0.9) == 1.0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = pipeline.table(spark, sf_dir, "documents")
    assert [name for name, _ in pipeline.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, sf_dir), "test_stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    whole = pipeline.run(spark, sf_dir)
    assert sorted(r["doc_id"] for r in whole.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert set(whole.columns) == {"doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded"}


def test_queries_equal_sql(spark, sf_dir):
    import duckdb

    from leafmark.llm.queries import QUERIES
    from leafmark.llm.sql import ORACLES

    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, sf_dir)
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns), name
        plain = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
        want = sorted(tuple(plain(x) for _, x in sorted(zip(names, r))) for r in found.fetchall())
        assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want, name
