import numpy as np

from rulewake.llm import annotators

LABELS = ["A-one", "B", "C"]


def simulated(n=1500, seed=4):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 3, n)
    rows = []
    for i, t in enumerate(truth):
        for rater, right in (("good", 0.9), ("fair", 0.7), ("weak", 0.5), ("other", 0.75), ("spam", 1 / 3), ("constant", None), ("swap", "swap")):
            if rng.random() < 0.7:
                if right is None:
                    label = 1
                elif right == "swap":
                    label = {0: 2, 2: 0}.get(int(t), 1) if rng.random() < 0.9 else int(rng.integers(0, 3))
                else:
                    label = int(t) if rng.random() < right else int((t + rng.integers(1, 3)) % 3)
                rows.append((f"i{i}", rater, LABELS[label], None))
    return truth, rows


def test_skills_and_consensus(spark):
    truth, rows = simulated()
    df = spark.createDataFrame(rows, "item_id string, rater string, label string, at timestamp")
    table, model = annotators.resolved(df, LABELS)
    skill = dict(zip(model.raters, model.skill))
    assert abs(skill["good"] - (0.9 * 3 - 1) / 2) < 0.1 and abs(skill["fair"] - (0.7 * 3 - 1) / 2) < 0.12 and abs(skill["spam"]) < 0.2
    best = {r.item_id: r.label for r in annotators.consensus(table, model).collect()}
    right = np.mean([best[f"i{i}"] == LABELS[t] for i, t in enumerate(truth) if f"i{i}" in best])
    # the yardstick is the best that anyone could do: votes weighted by the probabilities they were drawn with
    true = {r: np.full((3, 3), (1 - a) / 2) + np.eye(3) * (a - (1 - a) / 2) for r, a in (("good", 0.9), ("fair", 0.7), ("weak", 0.5), ("other", 0.75), ("spam", 1 / 3))}
    true["constant"] = np.tile([1e-9, 1, 1e-9], (3, 1))
    true["swap"] = 0.9 * np.eye(3)[[2, 1, 0]] + 0.1 / 3
    score, majority = np.zeros((len(truth), 3)), np.zeros((len(truth), 3))
    for item, rater, label, _ in rows:
        score[int(item[1:])] += np.log(true[rater][:, LABELS.index(label)])
        majority[int(item[1:]), LABELS.index(label)] += 1
    assert right > (score.argmax(1) == truth).mean() - 0.02 and right > (majority.argmax(1) == truth).mean() + 0.1
    bits = {r[0]: r[3] for r in annotators.reliability(model)}
    assert bits["swap"] > bits["fair"] > bits["spam"] and bits["constant"] < 0.1


def test_latest_answer_and_spelling_count(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [("x", "r", "a one", t), ("x", "r", " B ", t + dt.timedelta(days=1)), ("x", "r", " B ", t + dt.timedelta(days=1)), ("x", "s", "c", None), ("x", "t", "DISAGREE", t), (None, "r", "B", t), ("y", None, "B", t), ("y", "r", None, t)]
    table, raters = annotators.votes(spark.createDataFrame(rows, "item_id string, rater string, label string, at timestamp"), LABELS)
    row = table.collect()
    assert raters == ["r", "s"] and len(row) == 1 and list(row[0].raters) == [0, 1] and list(row[0].labels) == [1, 2]


def test_few_and_no_votes(spark):
    one = spark.createDataFrame([("x", "r", "B", None)], "item_id string, rater string, label string, at timestamp")
    table, model = annotators.resolved(one, LABELS)
    assert annotators.consensus(table, model).first().label == "B"
    table, model = annotators.resolved(one.limit(0), LABELS)
    assert annotators.consensus(table, model).count() == 0


def test_exchanged_labels_by_pairwise_counts(spark):
    truth, rows = simulated(3000, 6)
    _, model = annotators.resolved(spark.createDataFrame(rows, "item_id string, rater string, label string, at timestamp"), LABELS)
    swap = np.exp(model.weights[model.raters.index("swap")])
    constant = np.exp(model.weights[model.raters.index("constant")])
    assert swap[0, 2] > 0.75 and swap[2, 0] > 0.75 and constant[:, 1].min() > 0.9 and np.abs(model.prior - 1 / 3).max() < 0.05


def test_many_annotators(spark):
    rows = [(f"i{i}", f"r{i}", LABELS[i % 3], None) for i in range(2000)]
    table, model = annotators.resolved(spark.createDataFrame(rows, "item_id string, rater string, label string, at timestamp"), LABELS)
    assert len(model.raters) == 2000 and annotators.consensus(table, model).count() == 2000


def test_all_triplets_count():
    # 130 annotators share items with annotator 0; the 60 with most common items are copies of one another and tell nothing right
    n, k = 131, 2
    agreement = lambda right, common: np.array([[right, 1 - right], [1 - right, right]]) * common / 2
    counts = {}
    for i in range(n):
        for j in range(i + 1, n):
            copies = i > 0 and j <= 60
            counts[i, j] = agreement(0.99 if copies else 0.65 if i == 0 and j <= 60 else 0.82, 1000 if i == 0 and j <= 60 else 100)
    kappa = {p: annotators.beyond_chance(c) for p, c in counts.items()}
    both = lambda i, j: kappa[min(i, j), max(i, j)]
    skill, _ = annotators.triplets(counts, n)
    for i in (0, 1, 100):
        squares = [both(i, j) * both(i, m) / both(j, m) for j in range(n) for m in range(j + 1, n) if i not in (j, m)]
        assert abs(skill[i] - min(annotators.BOUND, np.sqrt(np.median(squares)))) < 1e-9
    assert skill[0] > 0.5  # by the pairs of the 60 alone it would be about 0.3
