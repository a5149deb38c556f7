import random
import re
from collections import defaultdict

from pixquill.llm import decontaminate

ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"),
    (2, "one two three four five six seven eight nine ten"),
    (3, "too short"),
    (4, None),
    (None, "an item without an id that has enough words to be found in a text somewhere"),
]


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items, stretch=decontaminate.STRETCH, similarity=decontaminate.SIMILARITY):
    """All diagonals that share a seed and have a stretch that agrees."""
    found = defaultdict(float)
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if d is None or i is None or not v:
                continue
            if len(v) < 8:  # word for word; below four words the document has nothing else
                for shift in range(len(w) - len(v) + 1):
                    if w[shift : shift + len(v)] == v and (len(v) >= 4 or w == v):
                        found[d, i, shift] = 1.0
                continue
            for shift in range(-len(v), len(w)):
                same = [0 <= shift + k < len(w) and w[shift + k] == x for k, x in enumerate(v)]
                seeded = any(
                    0 <= shift + k and shift + k + 8 <= len(w) and all(same[k + j] for j in range(8) if mask[j] == "1")
                    for mask in decontaminate.MASKS for k in range(len(v) - 7)
                )
                width = min(stretch, len(v))
                best = max(sum(same[k : k + width]) / width for k in range(len(v) - width + 1))
                if seeded and best >= similarity:
                    found[d, i, shift] = best
    return dict(found)


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(8, 30)))) for i in range(6)]
    docs = []
    for d in range(40):
        body = text(rng.randint(0, 60))
        if d % 2:
            passage = rng.choice(items)[1].split()
            a = rng.randint(0, len(passage) // 2)
            passage = [rng.choice(vocabulary) if rng.random() < 0.12 * (d % 5) else w for w in passage[a:]]
            body[5:5] = passage
        docs.append((d, " ".join(body)))
    found = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    )
    got = {(r["doc_id"], r["item_id"], r["shift"]): r["overlap"] for r in found.collect()}
    assert got == brute(docs, items) and got


def test_odd_documents(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = decontaminate.contaminated_documents(odd_docs, bench).collect()
    assert len(rows) == odd_docs.count() and not any(r["contaminated"] for r in rows)
    planted = [
        (1, "Before. " + ITEMS[0][1].upper() + " after."),
        (2, ITEMS[0][1].replace("delta", "x").replace("theta", "y")),
        (3, "nine ten one two three"),
        (4, "say: One, two; three four FIVE six seven eight nine-ten!"),
        (None, ITEMS[0][1]),
    ]
    docs = spark.createDataFrame(planted, "doc_id bigint, text string")
    found = {r["doc_id"]: r["contaminated"] for r in decontaminate.contaminated_documents(docs, bench).collect()}
    assert found == {1: True, 2: True, 3: False, 4: True, None: False}
    left = decontaminate.drop_contaminated(docs, bench)
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 3]
    assert decontaminate.contaminated_documents(no_docs, bench).count() == 0
    assert decontaminate.drop_contaminated(odd_docs, bench.where("false")).count() == odd_docs.count()


def test_short_items_match_word_for_word(spark):
    items = [(1, "a b c d e f g"), (2, "A-b c, d"), (3, "x y z"), (4, "yes"), (5, "a b c d e f g"), (6, "b b b b")]
    docs = [
        (1, "so a b c d e f g it goes"), (2, "a b c x d e f g"), (3, "x y z"), (4, "x y z w"), (5, "Yes!"), (6, "yes and no"),
        (7, None), (8, "b b b b b b"), (9, "a b c d a b c d"), (None, "x y z"),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"], r["shift"]): r["overlap"] for r in decontaminate.contamination(frame, bench).collect()}
    assert got == brute(docs, items)
    verdicts = {r["doc_id"]: r["n_items"] for r in decontaminate.contaminated_documents(frame, bench).collect()}
    assert verdicts == {1: 3, 2: 0, 3: 1, 4: 0, 5: 1, 6: 0, 7: 0, 8: 1, 9: 1, None: 0}


def test_items_too_heavy_to_broadcast(spark, monkeypatch):
    from pixquill.llm import common

    docs = [(1, ITEMS[0][1]), (2, ITEMS[1][1]), (3, "nothing of this")]
    frame, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = sorted(map(tuple, decontaminate.contamination(frame, bench).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, decontaminate.contamination(frame, bench).collect())) == want and len(want) == 2
