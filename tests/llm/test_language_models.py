import math
import random
from collections import Counter, defaultdict

import pytest

from pixquill.llm import char_lm, lm_scoring, quality_classifier

from .conftest import texts

ORDER = 3


def padded(text):
    return char_lm.START * (ORDER - 1) + char_lm.normal(text) + char_lm.END


def counted(all_texts):
    return Counter(p[i : i + ORDER] for t in all_texts for p in [padded(t)] for i in range(len(p) - ORDER + 1))


def brute_levels(top, continuation):
    levels = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        below = Counter()
        for gram, c in levels[k + 1].items():
            below[gram[1:]] += c if not continuation or gram[1:].startswith(char_lm.START) else 1
        levels[k] = below
    return levels


def brute_losses(levels, smooth, all_texts):
    """Mean loss of each text; ``smooth(k)`` gives (share of a count, weight of the lower order) per context."""
    size = len(levels[1]) + 1
    stats = {k: defaultdict(list) for k in levels}
    for k, level in levels.items():
        for gram, c in level.items():
            stats[k][gram[:-1]].append(c)

    def p(gram):
        if not gram:
            return 1 / size
        k, counts = len(gram), stats[len(gram)].get(gram[:-1])
        lower = p(gram[1:])
        if not counts:
            return lower
        share, weight = smooth(k, levels[k].get(gram, 0), counts)
        return share + weight * lower

    out = []
    for t in all_texts:
        s = padded(t)
        grams = [s[i : i + ORDER] for i in range(len(s) - ORDER + 1)]
        out.append((len(grams), -sum(math.log(p(g)) for g in grams) / len(grams)))
    return out


def kneser_ney(levels):
    d = {}
    for k, level in levels.items():
        few = Counter(level.values())
        d[k] = char_lm.discounts(*(few[i] for i in (1, 2, 3, 4)))
    cut = lambda k, c: d[k][min(c, 3) - 1] if c else 0
    return lambda k, c, counts: ((c - cut(k, c)) / sum(counts), sum(cut(k, x) for x in counts) / sum(counts))


def witten_bell(k, c, counts):
    whole = sum(counts) + len(counts)
    return c / whole, len(counts) / whole


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    syllables = ["ba", "do", "ti", "ka", "é"]
    return [(i, " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 30)))) for i in range(60)]


def test_cross_entropy_difference(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(3)
    target = spark.createDataFrame([(i,) for i in range(0, 60, 4)] + [(999,), (None,)], "doc_id bigint")
    rows = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(docs, target, order=ORDER).collect()}
    alltexts = [t for _, t in corpus]
    wanted = [t for i, t in corpus if i % 4 == 0]
    background = brute_levels(counted(alltexts), False)
    losses_b = brute_losses(background, witten_bell, alltexts)
    target_levels = brute_levels(counted(wanted), False)
    size = len(background[1])
    # both models have the vocabulary of the whole corpus
    target_levels[1].update({c: 0 for c in background[1] if c not in target_levels[1]})
    losses_t = brute_losses({k: Counter({g: c for g, c in v.items() if c}) if k > 1 else v for k, v in target_levels.items()}, lambda k, c, counts: witten_bell(k, c, [x for x in counts if x]), alltexts)
    assert size == len(target_levels[1])
    for (i, _), (n, b), (_, t) in zip(corpus, losses_b, losses_t):
        assert rows[i]["n_tokens"] == n
        assert abs(rows[i]["background_loss"] - b) < 1e-9 and abs(rows[i]["target_loss"] - t) < 1e-9
        assert abs(rows[i]["score"] - (t - b)) < 1e-9


def test_kneser_ney_perplexities(spark, corpus):
    docs = spark.createDataFrame([(i, t, "xx") for i, t in corpus], "doc_id bigint, text string, lang string").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(40)], "doc_id bigint")
    rows = {r["doc_id"]: r for r in quality_classifier.perplexities(docs, trusted, order=ORDER, size=15).collect()}
    trained = [t for i, t in corpus if rows[i]["trained"]]
    assert len(trained) == 15 and all(i < 40 for i, _ in corpus if rows[i]["trained"])
    levels = brute_levels(counted(trained), True)
    for (i, _), (n, loss) in zip(corpus, brute_losses(levels, kneser_ney(levels), [t for _, t in corpus])):
        assert rows[i]["n_tokens"] == n and abs(rows[i]["loss"] - loss) < 1e-9


def test_probabilities_sum_to_one(corpus):
    levels = brute_levels(counted([t for _, t in corpus]), True)
    smooth, size = kneser_ney(levels), len(levels[1]) + 1
    for ctx in list({g[:-1] for g in levels[ORDER]})[:20]:
        counts = [c for g, c in levels[ORDER].items() if g[:-1] == ctx]
        share = sum(smooth(ORDER, c, counts)[0] for c in counts)
        assert abs(share + smooth(ORDER, 0, counts)[1] - 1) < 1e-12 and size > 1


def test_long_texts_in_steps(spark, corpus, monkeypatch):
    whole = [t for _, t in corpus]
    want = [(int(o), int(k)) for _, _, key, own in char_lm.windows(whole, ORDER) for o, k in zip(own, key)]
    monkeypatch.setattr(char_lm, "STEP_CHARS", 7)
    got = [(int(o), int(k)) for _, _, key, own in char_lm.windows(whole, ORDER) for o, k in zip(own, key)]
    assert got == want


def brute_limits(known, everyone, accepted=quality_classifier.ACCEPTED):
    """{lang: limit} from rows (lang, n_tokens, loss), in steps of a thousandth."""

    def quantile(values, q):
        bins = sorted(math.floor(v * 1000) for v in values)
        return (bins[math.ceil(q * len(bins) - 1e-9) - 1] + 1) / 1000

    langs = sorted({r[0] for r in known})
    median = {k: quantile([r[2] for r in known if r[0] == k], 0.5) for k in langs}
    above = {k: [r[2] - median[k] - 1.5 / math.sqrt(r[1]) for r in known if r[0] == k] for k in langs}
    if not langs:
        return {}
    pooled = quantile([v for vs in above.values() for v in vs], accepted)
    out = {}
    for k in langs:
        weight = len(above[k]) / (len(above[k]) + 200)
        out[k] = median[k] + weight * quantile(above[k], accepted) + (1 - weight) * pooled
    for k in {r[0] for r in everyone} - set(langs):
        out[k] = quantile([r[2] for r in everyone if r[0] == k], 0.5) + pooled
    return out


def test_limits_equal_brute_force(spark):
    rng = random.Random(8)
    row = lambda lang, mean: (lang, rng.choice([30, 400, 9000]), rng.gauss(mean, 0.2))
    known = [row("a", 2.0) for _ in range(301)] + [row("b", 1.0) for _ in range(7)]
    everyone = known + [row("c", 3.0) for _ in range(41)] + [row("a", 5.0)]
    frames = [spark.createDataFrame(r, "lang string, n_tokens bigint, loss double") for r in (known, everyone)]
    got = {r["lang"]: r["limit"] for r in quality_classifier.language_limits(*frames).collect()}
    want = brute_limits(known, everyone)
    assert set(got) == {"a", "b", "c"} and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert quality_classifier.language_limits(frames[0].where("false"), frames[1]).collect() == []


def test_verdicts_equal_brute_force(spark):
    """The whole query from its losses: limits, standard errors, texts without words, languages nobody vouched for."""
    sf = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 9 == 0, F.lit("xx")).otherwise(F.col("lang")))
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 5, F.lit(" ")).otherwise(F.col("text")))
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id % 9 <> 0").select("doc_id").distinct()
    only = labels.where("doc_id % 9 <> 0")
    rows = quality_classifier.perplexities(docs, trusted).collect()
    good = {r["doc_id"] for r in trusted.collect()}
    filled = [r for r in rows if r["n_tokens"] > 1]
    known = [(r["lang"], r["n_tokens"], r["loss"]) for r in filled if not r["trained"] and r["doc_id"] in good]
    limits = brute_limits(known, [(r["lang"], r["n_tokens"], r["loss"]) for r in filled])
    assert "xx" in limits and "xx" not in {k[0] for k in known}
    want = {
        r["doc_id"]: r["n_tokens"] > 1 and r["loss"] <= limits[r["lang"]] + 1.5 / math.sqrt(r["n_tokens"]) for r in rows
    }
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.classify(docs, only).collect()}
    assert got == want and not want[5] and 0 < sum(want.values()) < len(want)


def test_held_out_documents(spark):
    """Trusted prose is kept, symbol noise is not."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    verdicts = quality_classifier.classify(docs, labels)
    assert verdicts.count() == docs.count()
    share = verdicts.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in share.collect()}
    assert kept[1] > 0.95 and kept[0] < 0.25


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (7, 1, 1), (None, 1, 0), (8, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality_classifier.classify(odd_docs, labels).collect()
    assert len(rows) == len(texts())
    for r in rows:
        assert (r["perplexity"] is None) == (r["n_tokens"] == 1)
        assert r["kept"] or r["n_tokens"] == 1 or r["limit"] is not None
    assert all(r["kept"] == (r["n_tokens"] > 1) for r in quality_classifier.classify(odd_docs, labels.where("false")).collect())
    left = quality_classifier.keep_good(odd_docs, labels)
    assert left.columns == odd_docs.columns and left.where("doc_id is null").count() == 1
    assert quality_classifier.classify(no_docs, labels).count() == 0
    scored = lm_scoring.cross_entropy_difference(odd_docs, labels.where("quality = 1"))
    assert scored.count() == len(texts()) and scored.where("score is null or isnan(score)").count() == 0
    assert lm_scoring.cross_entropy_difference(odd_docs, labels.where("false")).where("score is null").count() == 0
    assert lm_scoring.cross_entropy_difference(no_docs, labels).count() == 0


def test_toxic_documents_and_their_cost(spark):
    """English toxic documents are told apart at the cost of a known share of clean ones; others hardly (README)."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_classifier.classify(docs, labels).join(labels.where("quality = 1"), "doc_id")
    rows = judged.groupBy("lang", F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.avg((~F.col("kept")).cast("double")).alias("out"))
    out = {(r["lang"], r["toxic"]): r["out"] for r in rows.collect()}
    assert out["en", 1] > 0.7, out
    assert all(out[lang, 1] >= 0 and out[lang, 0] < 0.05 for lang in ("en", "de", "fr", "es")), out
    print("rejected", {k: round(v, 3) for k, v in sorted(out.items())})


def test_limits_of_rare_languages(spark):
    """A rare language is judged by its own median: the spread between languages does not reach its limit."""
    rng = random.Random(9)
    rows = [("a", 1.0 + abs(rng.gauss(0, 0.05))) for _ in range(400)] + [("b", 3.0 + abs(rng.gauss(0, 0.05))) for _ in range(400)]
    rare = [("rare", 1.8 + 0.01 * i) for i in range(5)]
    limits = {}
    for name, extra in (("few", rare), ("many", rare * 30)):
        df = spark.createDataFrame([(lang, 10_000, loss) for lang, loss in rows + extra], "lang string, n_tokens bigint, loss double")
        limits[name] = {r["lang"]: r["limit"] for r in quality_classifier.language_limits(df).collect()}
        assert set(limits[name]) == {"a", "b", "rare"}
        assert 1.82 < limits[name]["rare"] < 2.0  # junk of 2.64 goes; the pooled fence would be near 9
    assert abs(limits["few"]["rare"] - limits["many"]["rare"]) < 0.1


def test_the_classifier_trains_on_half_of_any_number_of_documents(spark):
    for n in (9_000, 9):
        assert quality_classifier.training_ids(spark.range(n).toDF("doc_id")).count() == n // 2
