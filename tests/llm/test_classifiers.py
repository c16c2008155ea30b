import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import linear, queries, quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64(F.col("doc_id") + 7), F.lit(4)) == 0
    return docs, labels, labels.where(~held), labels.where(held)


def test_toxicity_on_held_out_documents(spark, tables):
    docs, _, train, held = tables
    chain = toxicity.fit_chain(docs, train)
    got = toxicity.score(docs.join(held, "doc_id").select("doc_id", "text", "quality", F.col("toxic").alias("mark")), chain).select("text", "quality", "mark", "scores.toxic", "scores.low_quality").toPandas()
    called, mark = got["toxic"] >= toxicity.REJECT, got["mark"] == 1
    assert called[mark].mean() > 0.8, called[mark].mean()
    assert called[~mark].mean() < 0.01, called[~mark].mean()


def test_logistic_fit():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 3))
    y = (x[:, 0] + 0.1 * r.normal(size=400) > 0).astype(float)
    w = linear.fit_logistic(x, y)
    assert ((linear.sigmoid(x @ w[:-1] + w[-1]) > 0.5) == y).mean() > 0.95
    p = linear.sigmoid(x @ w[:-1] + w[-1])
    assert np.abs(x.T @ (p - y) + w[:-1]).max() < 1e-3  # the penalised gradient is zero
    assert linear.fit_logistic(x, np.zeros(400))[-1] < -5 and linear.fit_logistic(np.zeros((0, 3)), np.zeros(0))[-1] == 0


def slow_telling(rows, without):
    """rows: (words, fold, marks). Words by chi-square over the rows of the other folds."""
    rows = [(w, m) for w, f, m in rows if f != without]
    n, out = len(rows), set()
    for word in set().union(*(w for w, _ in rows)):
        t = sum(word in w for w, _ in rows)
        for k in range(len(rows[0][1])):
            p, a = sum(m[k] for _, m in rows), sum(m[k] for w, m in rows if word in w)
            below = t * (n - t) * p * (n - p)
            if t >= linear.LEAST_TEXTS and below and n * (a * n - t * p) ** 2 / below >= linear.LEAST_CHI2:
                out.add(word)
    return out


def made_table(spark, n, marked, seed=1):
    """Texts of common words; `marked(i, random)` gives (category 1, category 2, words to add)."""
    r = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        a, b, more = marked(i, r)
        docs.append((i, " ".join([*(f"w{j}" for j in r.integers(0, 40, 30)), *more])))
        labels.append((i, int(a), int(b)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, a int, b int")


def categories():
    return {"first": F.col("a") == 1, "second": F.col("b") == 1}


def test_features_are_chosen_without_the_fold(spark):
    def marked(i, r):
        a = r.random() < 0.3
        return a, r.random() < 0.2, ["mark"] * bool(a and r.random() < 0.7) + [f"rare{i % 97}"]

    docs, labels = made_table(spark, 600, marked)
    sample = linear.training_set(docs, labels, categories())
    text = {r.doc_id: set(linear.words_of(r.text)) for r in docs.collect()}
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(linear.FOLDS)).alias("f")).collect()}
    rows = [(text[r.doc_id], fold[r.doc_id], (r.a, r.b)) for r in labels.collect()]
    for i, f in enumerate([*range(linear.FOLDS), None]):
        assert {w for w, told in zip(sample.words, sample.told[:, i], strict=True) if told} == slow_telling(rows, f), f
    for f in range(linear.FOLDS):
        x = sample.design(f)[1][sample.fold != f][:, : len(linear.STYLE)]
        assert np.abs(x.mean(axis=0)).max() < 1e-5


def test_random_labels_are_not_predicted_out_of_fold(spark):
    docs, labels = made_table(spark, 800, lambda i, r: (r.random() < 0.5, r.random() < 0.5, [f"own{r.integers(0, 150)}" for _ in range(6)]), seed=3)
    kept, linear.LEAST_CHI2 = linear.LEAST_CHI2, 4.0  # so that chance words are chosen, which would tell if the fold's labels were seen
    try:
        sample = linear.training_set(docs, labels, categories())
    finally:
        linear.LEAST_CHI2 = kept
    assert sample.told.sum() > 20
    z, y = sample.held_out(0, np.zeros((len(sample.fold), 0))), sample.marks[:, 0]
    order = z.argsort().argsort()
    auc = (order[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert abs(auc - 0.5) < 0.07, auc


def test_chain_uses_earlier_categories(spark):
    """The second category shows in no word of its own but follows the first."""

    def marked(i, r):
        a = r.random() < 0.4
        return a, a and r.random() < 0.9, ["sign"] * bool(a)

    docs, labels = made_table(spark, 700, marked)
    chain = toxicity.fit_chain(docs, labels, categories())
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and chain.weights[1][-2] > 0.1
    got = {r.doc_id: r.scores for r in toxicity.score(docs, chain).collect()}
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    x = chain.features.of(texts)
    first = 1 / (1 + np.exp(-(x @ chain.weights[0][:-1] + chain.weights[0][-1])))
    second = 1 / (1 + np.exp(-(np.hstack([x, np.log(first / (1 - first))[:, None]]) @ chain.weights[1][:-1] + chain.weights[1][-1])))
    assert np.allclose([got[i].first for i in range(700)], first) and np.allclose([got[i].second for i in range(700)], second, atol=1e-5)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "sign " * 50000, 3), (3, "sign " * 50000, 3)], "doc_id long, text string, scores int")
    out = toxicity.score(odd, chain)
    assert out.columns == [*odd.columns, "scores_"] and out.count() == 4 and len({r["scores_"] for r in out.where("doc_id = 3").collect()}) == 1


def test_quality_on_held_out_documents(tables):
    docs, _, train, held = tables
    got = quality.quality(docs, train).join(held, "doc_id").toPandas()
    assert ((got["p_quality"] >= 0.5) == (got["quality"] == 1)).mean() > 0.93
    assert got["keep"][got["quality"] == 1].mean() > 0.97
    assert got["p_path"].between(0, 1).all()


def slow_quality(rows, share):
    """p_host, p_path and p_quality from (host, path, p_text) rows, in plain Python."""
    clip = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    logit = lambda p: np.log(clip(p) / (1 - clip(p)))

    def grouped(keys):
        out = {}
        for k, p in zip(keys, [p for *_, p in rows], strict=True):
            n, s = out.get(k, (0, 0.0))
            out[k] = n + 1, s + p
        return out

    def strength(groups, mean):
        n = np.array([g[0] for g in groups.values()], float)
        s = np.array([g[1] for g in groups.values()])
        m = np.array([mean[k] for k in groups])
        within = (m * (1 - m)).mean()
        if len(n) < 2 or not within:
            return quality.STRENGTH[1]
        spread, below = (n * (s / n - m) ** 2).sum(), n.sum() - (n * n).sum() / n.sum()
        between = (spread - (len(n) - 1) * within) / below if below > 0 else 0.0
        return float(np.clip(within / between - 1 if between > 0 else quality.STRENGTH[1], *quality.STRENGTH))

    share_of = lambda own, prior, k: (sum(own) + k * prior) / (len(own) + k)
    hosts, paths = grouped([h for h, _, _ in rows]), grouped([(h, p) for h, p, _ in rows])
    overall = sum(p for *_, p in rows) / len(rows)
    k_host = strength(hosts, dict.fromkeys(hosts, overall))
    k_path = strength(paths, {x: (hosts[x[0]][1] + k_host * overall) / (hosts[x[0]][0] + k_host) for x in paths})
    at_host, at_path, made, out = {}, {}, {}, []
    for i, (h, path, _) in enumerate(rows):
        at_host.setdefault(h, []).append(i)
        at_path.setdefault((h, path), []).append(i)
    for i, (h, path, p) in enumerate(rows):
        if (h, path, p) not in made:  # from the rows that are left when this one is taken out
            left = lambda own, i=i: [rows[j][2] for j in own if j != i]
            p_host = share_of(left(at_host[h]), np.mean(left(range(len(rows)))), k_host)
            prior = share_of(left(at_path[h, path]), p_host, k_path)
            made[h, path, p] = p_host, prior, 1 / (1 + np.exp(-(logit(prior) + logit(p) - np.log(share / (1 - share)))))
        out.append(made[h, path, p])
    return out


def test_a_document_alone_at_its_site_does_not_meet_itself(spark, tables):
    docs, labels, *_ = tables
    some = docs.where("doc_id < 400").select("doc_id", "text", F.lit("all").alias("source"), F.lit("x").alias("lang"))
    alone = docs.where("doc_id between 400 and 405").select("doc_id", "text", F.concat(F.lit("own"), "doc_id").alias("source"), F.lit("x").alias("lang"))
    got = {r.doc_id: r for r in quality.quality(some.unionByName(alone), labels).collect()}
    every = [r.p_text for r in got.values()]
    for i in range(400, 406):
        if i in got:
            others = (sum(every) - got[i].p_text) / (len(every) - 1)
            assert got[i].p_host == pytest.approx(others) and got[i].p_path == pytest.approx(others)


def test_site_shares_match_brute_force_and_ties(spark, tables):
    docs, labels, *_ = tables
    some = docs.where("doc_id < 3000").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "hot").otherwise(F.concat(F.lit("h"), F.pmod("doc_id", F.lit(40)))).alias("source"), "lang")
    some = some.unionByName(some.where("doc_id < 50")).unionByName(some.where("doc_id < 20"))  # repeated rows
    got = quality.quality(some, labels).join(some.select("doc_id", "source", "lang").distinct(), "doc_id").collect()
    sample = linear.training_set(some, labels, {"good": F.col("quality") == 1})
    share = (sample.marks.sum() + 0.5) / (len(sample.marks) + 1)
    expected = slow_quality([(x.source or "", x.lang or "", x.p_text) for x in got], share)
    assert np.allclose([(x.p_host, x.p_path, x.p_quality) for x in got], expected, atol=1e-9)
    assert len(got) == some.count()
    same = spark.createDataFrame([(i, "one and the same text", "h", "p") for i in range(20)], "doc_id long, text string, source string, lang string")
    assert len({(x.p_text, x.p_quality) for x in quality.quality(same, labels).collect()}) == 1


def test_sparse_sites_shrink_and_edges(spark, edge, none, tables):
    docs = edge.select("doc_id", "text", F.lit(None).cast("string").alias("source"), F.lit("x").alias("lang"), F.lit(1).alias("p_text"))
    labels = tables[1]
    got = quality.quality(docs, labels).collect()
    assert len(got) == edge.count() and all(0 <= r.p_quality <= 1 for r in got)
    assert all(r.keep and r.p_text == 0.5 for r in quality.quality(docs, labels.where("false")).collect())
    assert quality.quality(docs.where("false"), labels).count() == 0
    chain = toxicity.fit_chain(docs, labels.where("false"))
    assert {(r.scores.low_quality, r.scores.toxic) for r in toxicity.score(docs, chain).collect()} == {(0.5, 0.5)}
    assert toxicity.score(none, toxicity.fit_chain(edge, labels)).count() == 0


def test_queries_cover_every_row(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert queries.op8_toxicity(spark, SF).count() == n and queries.op3_quality(spark, SF).count() == n
