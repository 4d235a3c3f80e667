import random

import numpy as np

from vectorloom.llm import quality as Q


def corpus(n=400, seed=6):
    random.seed(seed)
    docs, labels = [], []
    words = "the river ran past old houses and quiet fields where people worked all day".split()
    for i in range(n):
        good = random.random() < 0.8
        body = random.choices(words, k=random.randint(20, 80))
        text = ". ".join(" ".join(body[k : k + 8]).capitalize() for k in range(0, len(body), 8)) + "." if good else " | ".join(w + "###" for w in body)
        docs.append((i, text, "en", f"s{i % 4}"))
        if i % 2:
            labels.append((i, int(good)))
    return docs, labels


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, lang string, source string, score double")


def test_separates_and_keeps(spark):
    docs, labels = corpus()
    df, ld = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.quality_scores(df, ld).collect()}
    assert len(got) == len(docs)
    bad = {i for i, t, *_ in docs if "###" in t}
    assert {i for i, r in got.items() if r.rejected} == bad
    kept = Q.keep_good(df, ld)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(got) - bad


def test_priors_match_brute_force(spark):
    docs, labels = corpus(60)
    docs += [(900 + k, "The river ran past old houses.", None, "rare") for k in range(2)]
    got = {r.doc_id: r for r in Q.quality_scores(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    p = {i: got[i].evidence for i, *_ in docs}
    share = np.mean(list(p.values()))

    def strength(groups, parent):
        rows = [(len(v), np.mean(v), np.mean(np.square(v)) - np.mean(v) ** 2, parent[k]) for k, v in groups.items() if len(v) >= 2]
        n = sum(r[0] for r in rows)
        between, within, noise = sum(r[0] * (r[1] - r[3]) ** 2 for r in rows) / n, sum(r[0] * r[2] for r in rows) / n, sum(r[2] for r in rows) / n
        return min(1000.0, max(1.0, within / max(between - noise, 1e-9)))

    hosts, sites = {}, {}
    for i, _, lang, source in docs:
        hosts.setdefault(source, []).append(p[i])
        sites.setdefault((source, lang), []).append(p[i])
    m1 = strength(hosts, dict.fromkeys(hosts, share))
    hm = {h: (sum(v) + m1 * share) / (len(v) + m1) for h, v in hosts.items()}
    m2 = strength(sites, {s: hm[s[0]] for s in sites})
    for i, _, lang, source in docs:
        host = (sum(hosts[source]) - p[i] + m1 * share) / (len(hosts[source]) - 1 + m1)
        host = min(max(host, 1e-6), 1 - 1e-6)
        site = (sum(sites[source, lang]) - p[i] + m2 * host) / (len(sites[source, lang]) - 1 + m2)
        assert abs(got[i].host_prior - host) < 1e-6 and abs(got[i].site_prior - site) < 1e-6


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = [(1, None, None, None), (2, "", "en", "s"), (3, "word " * 100_000, "en", "s"), (None, "a b", "en", "s"), (2, "", "en", "s")]
    rows = Q.quality_scores(frame(spark, docs), none).collect()
    assert len(rows) == 5 and not any(r.rejected for r in rows)
    assert Q.quality_scores(frame(spark, docs).limit(0), none).count() == 0
    one = spark.createDataFrame([(2, 1), (3, 1), (77, 0), (2, None)], "doc_id long, quality int")
    assert not any(r.rejected for r in Q.quality_scores(frame(spark, docs), one).collect())
