"""Set value, trajectories, training rows, losses, selections, metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions.prompts import VERBALIZERS
from gleanery.operators import evaluate, losses, posterior, selection, setvalue, training
from gleanery.plans.views import digest_scorer

LABELS = ["SUPPORTS", "REFUTES"]
DDL = "id string, query string, label string, split string, labels array<string>, eta0 array<double>, candidates array<struct<doc_id:string,rank:int,retrieval_score:double,title:string,text:string,eta:array<double>>>"


def toy():
    cand = lambda d, r, s, e: {"doc_id": d, "rank": r, "retrieval_score": s, "title": "t", "text": d, "eta": e}
    return [
        ("toy_001", "q1", "SUPPORTS", "train", LABELS, [0.4, 0.6], [cand("doc_good", 1, 10.0, [0.9, 0.1]), cand("doc_bad", 2, 9.0, [0.2, 0.8]), cand("doc_weak", 3, 8.0, [0.45, 0.55])]),
        ("toy_002", "q2", "REFUTES", "train", LABELS, [0.55, 0.45], [cand("doc_paris", 1, 11.0, [0.1, 0.9]), cand("doc_berlin", 2, 10.0, [0.5, 0.5]), cand("doc_noise", 3, 7.0, [0.6, 0.4])]),
        ("empty", "q3", "REFUTES", "train", LABELS, [0.5, 0.5], []),
    ]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(toy(), DDL)


def test_golden_trajectory(posts):
    rows = {r["id"]: r for r in setvalue.greedy_teacher(posts, 4, 0.01, 0.001).collect()}
    one, two = rows["toy_001"], rows["toy_002"]
    assert one["teacher_selected_doc_ids"] == ["doc_good", "doc_bad", "doc_weak"] and two["teacher_selected_doc_ids"] == ["doc_paris", "doc_noise", "doc_berlin"]
    assert [s["theta_after"] for s in one["steps"]] == pytest.approx([0.704465767, 0.706379248, 0.706481228], abs=1e-8)
    assert [s["theta_after"] for s in two["steps"]] == pytest.approx([0.589238278, 0.589411900, 0.589580759], abs=1e-8)
    assert [g["gain"] for g in one["steps"][0]["candidate_gains"]] == pytest.approx([0.704465767, 0.638791564, 0.238881307], abs=1e-8)
    assert one["direction"] == pytest.approx([0.5994, -0.5994])
    assert [c["norm_x"] for c in one["candidates"]] == pytest.approx([0.706965360, 0.282984134, 0.070569257], abs=1e-8)
    assert one["stop_reason"] == "no_candidates" and rows["empty"]["stop_reason"] == "no_candidates" and rows["empty"]["steps"] == []


def test_stops(posts):
    rows = {r["id"]: r for r in setvalue.greedy_teacher(posts, 4, 0.01, 0.001, stop_below=0.001, store_all_gains=False).collect()}
    assert rows["toy_001"]["teacher_selected_doc_ids"] == ["doc_good", "doc_bad"] and rows["toy_001"]["stop_reason"] == "gain_below_threshold"
    assert rows["toy_001"]["terminal_stop_decision"]["step"] == 2 and rows["toy_001"]["steps"][0]["candidate_gains"] == []
    assert setvalue.greedy_teacher(posts, 0).where("id = 'toy_001'").first()["stop_reason"] == "top_m_reached"
    for bad in ({"top_m": -1}, {"ridge": 0}, {"tolerance": -1}, {"metric": "bw"}, {"smoothing": "x"}, {"eps": 1.0}):
        with pytest.raises(ValueError):
            setvalue.greedy_teacher(posts, **bad)


@pytest.mark.parametrize("ridge", [1e-10, 0.01, 1000])
def test_identity_and_monotone(ridge):
    rng = np.random.default_rng(3)
    for k in (2, 3):
        x = rng.dirichlet(np.ones(k), 6) - rng.dirichlet(np.ones(k))
        d = np.eye(k)[0] - rng.dirichlet(np.ones(k))
        steps, reason, _ = setvalue.greedy(x, d, 10, ridge)
        assert reason == "no_candidates" and len(steps) == 6
        chosen = []
        for s in steps:
            assert s["before"] == pytest.approx(setvalue.set_value(x, d, chosen, ridge), abs=1e-7)
            chosen.append(s["best"])
            assert s["after"] >= s["before"] - 1e-8
    x = np.array([[1, 0], [1, 0], [0, 1], [0, 0]], float)
    steps, _, _ = setvalue.greedy(x, np.array([1, 0.5]), 10, 0.01)
    assert sorted(s["best"] for s in steps) == [0, 1, 2, 3] and steps[0]["best"] == 0
    assert setvalue.greedy(x, np.array([1, 0.5]), 10, 0.01, stop_below=10)[:2] == ([], "gain_below_threshold")


def test_golden_features(posts):
    teacher = setvalue.greedy_teacher(posts, 4, 0.01, 0.001)
    rows = {(r["id"], r["step"], r["doc_id"]): r for r in training.feature_rows(teacher, posts).collect()}
    a = [0.4, 0.6, 0.9, 0.1, 0.5, -0.5, 0.5, 0.5, 0.673012, 0.325083, 0.347929, 0.707107, 1, 10, 0, 0, 0, 0, 0, 0]
    b = [0.4, 0.6, 0.2, 0.8, -0.2, 0.2, 0.2, 0.2, 0.673012, 0.500402, 0.172609, 0.282843, 0.5, 9, 1, 1, 0.5, -0.5, -1, -1]
    assert rows["toy_001", 0, "doc_good"]["features"] == pytest.approx(a, abs=1e-6) and rows["toy_001", 0, "doc_good"]["is_best"] == 1
    assert rows["toy_001", 1, "doc_bad"]["features"] == pytest.approx(b, abs=1e-6)
    assert len(rows) == 12 and len(training.feature_names(LABELS)) == 20
    one = selection.feature_matrix(np.array([[0.4, 0.6]]), np.array([[[0.9, 0.1], [0.2, 0.8]]]), np.array([[1, 0.5]]), np.array([[10.0, 9.0]]), np.array([[0]]))
    assert one[0, 1] == pytest.approx(b, abs=1e-6)
    assert tuple(training.train_balance(training.feature_rows(teacher, posts)).first()) == (6, 6, True)
    model = training.fit_selector(training.feature_rows(teacher, posts))
    assert len(model.weights) == 20 and model.steps[-1][-1] < model.steps[0][-1]
    with pytest.raises(Exception, match="no posterior row"):
        training.feature_rows(teacher, posts.where("id <> 'toy_001'")).collect()


def test_groups(spark, posts):
    teacher = setvalue.greedy_teacher(posts, 4, 0.01, 0.001)
    bare = posts.withColumn("candidates", F.transform("candidates", lambda c: c.withField("text", F.lit("")).withField("title", F.lit(None).cast("string"))))
    cand = "array<struct<doc_id:string,rank:int,score:double,title:string,text:string>>"
    found = spark.createDataFrame([("toy_001", [{"doc_id": d, "rank": 9, "score": 1.0, "title": None, "text": "x " + d} for d in ("doc_good", "doc_bad", "new")])], f"id string, candidates {cand}")
    rows = training.listwise_groups(teacher, bare, found).collect()
    assert [(r["id"], r["step"], [c["doc_id"] for c in r["candidates"]]) for r in rows] == [("toy_001", 0, ["doc_good", "doc_bad"])]
    assert rows[0]["candidates"][0]["text"] == "x doc_good" and rows[0]["candidates"][0]["rank"] == 1
    assert tuple(training.group_stats(teacher, bare, found).first()) == (1, 9, 5)


SCORED = [("g", 0, 0.3, 0.2), ("g", 0, -0.2, 0.0001), ("g", 0, 0.1, 0.005), ("p", 0, 0.0, 0.2), ("p", 0, 1.0, 0.3)]


def test_losses(spark):
    rows = spark.createDataFrame(SCORED, "id string, step int, score double, gain double")
    got = {r["id"]: r for r in losses.multitask_loss(rows, 0.01, 0.001, 2.0, 0.5, "ignore").collect()}
    g = got["g"]
    assert (g["num_positive"], g["num_negative"], g["num_neutral"], g["valid"]) == (1, 1, 1, True)
    assert (g["ce_loss"], g["rank_loss"], g["total"]) == pytest.approx((0.576247057, 0.313261688, 0.444754372), abs=1e-8)
    assert got["p"]["rank_loss"] == 0 and not got["p"]["valid"]
    neg = losses.multitask_loss(rows, 0.01, 0.001, 2.0, 0.5, "negative").where("id = 'g'").first()
    assert (neg["ce_loss"], neg["total"]) == pytest.approx((0.632296925, 0.472779306), abs=1e-8)
    two = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 0, 1.0, 1.0)], "id string, step int, score double, gain double")
    assert losses.listwise_loss(two).first()["loss"] == pytest.approx(0.313307085, abs=1e-8)
    for bad in ((0.001, 0.01), (0.01, 0.0)):
        with pytest.raises(ValueError):
            losses.multitask_loss(rows, *bad)
    report = losses.loss_report(losses.multitask_loss(rows, 0.01, 0.001)).first()
    assert (report["groups"], report["valid_groups"], report["skipped_groups"]) == (2, 1, 1)


def test_selections(posts):
    naive = selection.select_naive(posts, 2).collect()
    by = {r["id"]: r for r in naive}
    assert by["toy_001"]["selected_doc_ids"] == ["doc_good", "doc_bad"] and by["toy_001"]["stop_reason"] == "top_m_reached"
    assert by["empty"]["num_docs"] == 0 and by["empty"]["stop_reason"] == "no_candidates"
    assert [s["remaining_count"] for s in by["toy_001"]["selection_steps"]] == [3, 2]
    assert selection.selection_violations(selection.select_naive(posts, 2)).count() == 0
    teacher = setvalue.greedy_teacher(posts, 4, 0.01, 0.001)
    oracle = {r["id"]: r for r in selection.select_oracle(teacher, posts, 2).collect()}
    assert oracle["toy_002"]["selected_doc_ids"] == ["doc_paris", "doc_noise"] and oracle["toy_002"]["diagnostic_only"] and not oracle["toy_002"]["deployable"]
    with pytest.raises(Exception, match="not found"):
        selection.select_oracle(teacher, posts.withColumn("candidates", F.slice("candidates", 1, 1))).collect()


def test_model_selection(posts):
    # The retrieval score alone (feature 13), in units of one.
    scorer = lambda: selection.linear_scorer([0.0] * 13 + [1.0] + [0.0] * 6, 0.0)
    rows = {r["id"]: r for r in selection.select_with_model(posts, scorer, top_m=5, min_docs=2, threshold=9.5).collect()}
    one = rows["toy_001"]
    assert one["selected_doc_ids"] == ["doc_good", "doc_bad"] and one["stop_reason"] == "score_below_threshold"
    assert [s["selected_doc_id"] for s in one["selection_steps"]] == ["doc_good", "doc_bad", None]
    assert rows["toy_002"]["num_docs"] == 2 and rows["empty"]["stop_reason"] == "no_candidates"
    assert selection.select_with_model(posts, scorer, top_m=0).first()["stop_reason"] == "top_m_reached"


def test_metrics(spark):
    rows = [("1", "A", "A", [0.9, 0.1], 1, 10), ("2", "A", "B", [0.1, 0.9], 2, 20), ("3", "B", None, None, 2, 0), ("4", "B", "C", [float("nan"), 0.2], 5, 0)]
    preds = spark.createDataFrame(rows, "id string, gold string, pred string, probs array<double>, num_docs int, evidence_chars int")
    s = evaluate.summary(preds).first()
    assert (s["num_examples"], s["num_correct"], s["accuracy"], s["median_num_docs"], s["num_non_finite"], s["num_missing"]) == (4, 1, 0.25, 2.0, 1, 1)
    per = {r["label"]: tuple(r)[1:] for r in evaluate.per_class(preds, ["A", "B", "D"]).collect()}
    assert per == {"A": (2, 1, 0.5), "B": (1, 0, 0.0), "D": (0, 0, 0.0)}
    grid = {(r["gold"], r["pred"]): r["n"] for r in evaluate.confusion(preds, ["A", "B"]).collect()}
    assert grid == {("A", "A"): 1, ("A", "B"): 1, ("B", "A"): 0, ("B", "B"): 0}
    assert {r["label"] for r in evaluate.label_table(preds).collect()} == {"A", "B", "C"}
    doc = evaluate.metrics_document(preds, ["A", "B"]).first()
    assert doc["num_docs_histogram"] == {"1": 1, "2": 2, "5": 1} and doc["confusion_matrix"]["A"] == {"A": 1, "B": 1}
    none = evaluate.summary(preds.limit(0)).first()
    assert none["num_examples"] == 0 and none["accuracy"] == 0.0
    bare = evaluate.summary(preds.select("id", "gold", "pred")).first()
    assert bare["avg_num_docs"] == 0.0


def test_marginal_gain():
    x, d = np.array([[0.5, -0.5], [0.2, -0.2], [-0.1, 0.1]]), np.array([0.6, -0.6])
    assert setvalue.marginal_gain(x, d, [], 0, 0.01) == pytest.approx(float(x[0] @ d) ** 2 / (float(x[0] @ x[0]) + 0.01))
    assert setvalue.marginal_gain(x, d, [0, 2], 1, 0.01) == pytest.approx(setvalue.set_value(x, d, [0, 1, 2], 0.01) - setvalue.set_value(x, d, [0, 2], 0.01))
    with pytest.raises(ValueError, match="selected already"):
        setvalue.marginal_gain(x, d, [0], 0, 0.01)


def test_posterior_job_resumes(spark, tmp_path):
    ddl = "id long, query string, label string, split string, candidates array<struct<doc_id:string,rank:int,score:double,title:string,text:string>>"
    rows = [(i, f"claim {i}", "SUPPORTS", "dev", [{"doc_id": "a", "rank": 1, "score": 2.0, "title": None, "text": f"text {i}"}] if i else []) for i in range(6)]
    found, path = spark.createDataFrame(rows, ddl), f"file://{tmp_path}/posteriors"
    asked = []

    def job(source, verbalizers=VERBALIZERS):
        out = posterior.append_posteriors(source, path, digest_scorer, LABELS, verbalizers)
        asked.append(out.count())
        return {r["id"]: r for r in out.collect()}

    assert job(found.limit(0)) == {}
    part = job(found.where("id < 4"))
    whole = job(found)
    assert set(whole) == set(range(6)) and all(whole[i] == part[i] for i in part)
    assert job(found) == whole and asked == [0, 4, 6, 6]
    fresh = {r["id"]: r for r in posterior.score_posteriors(found, digest_scorer, LABELS, VERBALIZERS).collect()}
    assert all((whole[i]["eta0"], whole[i]["candidates"]) == (fresh[i]["eta0"], fresh[i]["candidates"]) for i in fresh)
    with pytest.raises(ValueError, match="other prompts"):
        job(found, {"SUPPORTS": ["X"], "REFUTES": ["B"]})
    with pytest.raises(ValueError, match="unexpected"):
        job(found.where("id < 3"))


def test_epoch_order(spark):
    groups = spark.createDataFrame([(i, s) for i in range(20) for s in range(3)], "id long, step int")
    order = lambda seed, epoch: [tuple(r) for r in training.epoch_order(groups.repartition(3), seed, epoch).collect()]
    assert order(7, 1) == order(7, 1) != order(7, 2)
    assert sorted(order(7, 1)) == sorted(order(7, 2)) == [(i, s) for i in range(20) for s in range(3)]


def random_posteriors(seed, rows=40, k=3):
    rng = np.random.default_rng(seed)
    labels = [f"L{i}" for i in range(k)]
    out = []
    for i in range(rows):
        n = int(rng.integers(0, 8))
        ids = [f"d{int(j)}" for j in rng.integers(0, 6, n)]  # with repeats
        cands = [{"doc_id": d, "rank": int(rng.integers(0, 4)), "retrieval_score": float(rng.integers(0, 3)), "title": None if j % 2 else f"t{j}", "text": f"text {d}", "eta": rng.dirichlet(np.ones(k)).round(2).tolist()} for j, d in enumerate(ids)]
        out.append((f"r{i}", None if i == 3 else f"claim {i}", labels[i % k], "dev", labels, rng.dirichlet(np.ones(k)).tolist(), cands))
    return out


@pytest.mark.parametrize("ridge", [1e-9, 0.01])
def test_lock_step_equals_single_rows(spark, ridge):
    """Rows of all sizes at once against a plain loop over set values."""
    rows = random_posteriors(1)
    df = spark.createDataFrame(rows, DDL)
    teacher = {r["id"]: r for r in setvalue.greedy_teacher(df, 3, ridge, 0.001, stop_below=0.01).collect()}
    for i, _, label, _, labels, eta0, cands in rows:
        base = 0.999 * np.array(eta0) + 0.001 / 3
        d = 0.999 * (np.array(labels) == label) + 0.001 / 3 - base
        x = np.array([c["eta"] for c in cands]).reshape(len(cands), 3) - base
        chosen, value, reason = [], 0.0, "no_candidates"
        for _ in range(min(3, len(cands))):
            gains = {j: setvalue.set_value(x, d, [*chosen, j], ridge) - value for j in range(len(cands)) if j not in chosen}
            best = max(gains, key=lambda j: (round(gains[j], 7), -j))
            if gains[best] < 0.01:
                reason = "gain_below_threshold"
                break
            chosen.append(best)
            value += gains[best]
            reason = "top_m_reached" if len(chosen) == 3 else "no_candidates"
        got = teacher[i]
        assert got["theta_final"] == pytest.approx(value, abs=1e-6)
        assert (len(got["teacher_selected_indices"]), got["stop_reason"]) == (len(chosen), reason)
        if ridge < 1e-6:  # all second picks that aren't parallel to the first complete the space: equal up to rounding
            continue
        assert got["teacher_selected_indices"] == chosen
        assert got["teacher_selected_doc_ids"] == [cands[j]["doc_id"] for j in chosen]
        for s in got["steps"]:
            assert [g["index"] for g in s["candidate_gains"]] == [j for j in range(len(cands)) if j not in chosen[: s["step"]]]
            assert s["current_indices"] == chosen[: s["step"]] and s["current_doc_ids"] == [cands[j]["doc_id"] for j in s["current_indices"]]


def test_helpers_get_no_texts(spark):
    """Neither the trajectory nor the feature model's choice sends ids, queries or texts to Python."""
    df = spark.createDataFrame(random_posteriors(2), DDL)
    for made in (setvalue.greedy_teacher(df, 2), selection.select_with_model(df, lambda: lambda f: f[:, 0])):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        calls = [line for line in plan.splitlines() if "ArrowEvalPython" in line or "run(" in line]
        assert calls and not any("query" in c.split("[", 1)[1].split("]", 1)[0] for c in calls if "[" in c)


def plain_choice(cands, score, top_m, min_docs, threshold):
    chosen, steps, reason = [], [], "no_candidates" if top_m else "top_m_reached"
    for step in range(min(top_m, len(cands))):
        taken = {cands[j]["doc_id"] for j in chosen}
        left = [j for j, c in enumerate(cands) if c["doc_id"] not in taken]
        if not left:
            break
        scored = {j: score(chosen, j) for j in left}
        best = max(left, key=lambda j: (scored[j], -cands[j]["rank"]))
        stop = threshold is not None and len(chosen) >= min_docs and scored[best] < threshold
        tops = sorted(left, key=lambda j: scored[j], reverse=True)[:5]
        steps.append((step, None if stop else cands[best]["doc_id"], scored[best], len(left), stop, [cands[j]["doc_id"] for j in tops]))
        if stop:
            reason = "score_below_threshold"
            break
        chosen.append(best)
        reason = "top_m_reached" if len(chosen) >= top_m else "no_candidates"
    return chosen, steps, reason


@pytest.mark.parametrize("threshold,batch", [(None, 1), (0.7, 7)])
def test_text_model_against_a_plain_loop(spark, threshold, batch):
    rows = random_posteriors(4)

    def text(query, cands, chosen, j):
        titled = lambda c: f"{c['title']}: {c['text']}" if c["title"] else c["text"]
        history = "\n".join(f"[{i + 1}] {titled(cands[k])}" for i, k in enumerate(chosen[-4:])) if chosen else "None"
        return f"Claim:\n{query}\n\nCandidate evidence:\n{titled(cands[j])}\n\nAlready selected evidence:\n{history}\n\nTask:\nScore how useful the candidate evidence is as an additional evidence item for verifying the claim, considering the already selected evidence."

    coarse = lambda texts: np.floor(digest_scorer()(texts)[:, 0] * 5) / 5  # noqa: E731  with ties
    got = {r["id"]: r for r in selection.select_with_text_model(spark.createDataFrame(rows, DDL), lambda: coarse, 5, 2, threshold, batch_size=batch).collect()}
    for i, query, _, _, _, _, cands in rows:
        chosen, steps, reason = plain_choice(cands, lambda c, j: float(coarse([text("None" if query is None else query, cands, c, j)])[0]), 5, 2, threshold)  # noqa: B023
        r = got[i]
        assert r["selected_doc_ids"] == [cands[j]["doc_id"] for j in chosen] and r["stop_reason"] == reason
        assert [(s["step"], s["selected_doc_id"], s["predicted_score"], s["remaining_count"], s["stop"], [c["doc_id"] for c in s["top_candidates"]]) for s in r["selection_steps"]] == steps
        assert [d["selector_score"] for d in r["selected_docs"]] == [s[2] for s in steps if not s[4]]
    with pytest.raises(Exception, match="another number"):
        selection.select_with_text_model(spark.createDataFrame(rows, DDL), lambda: lambda t: np.ones(len(t) + 1)).collect()


def test_feature_model_against_a_plain_loop(spark):
    rows = random_posteriors(5)
    weights = np.round(np.random.default_rng(0).normal(size=25), 2)
    got = {r["id"]: r for r in selection.select_with_model(spark.createDataFrame(rows, DDL), lambda: selection.linear_scorer(weights, 0.1), 4, 1, -1.0).collect()}
    for i, _, _, _, _, eta0, cands in rows:
        def score(chosen, j, cands=cands, eta0=eta0):
            eta = np.array([[c["eta"] for c in cands]])
            rank = np.array([[float(c["rank"]) for c in cands]])
            inverse = np.where(rank > 0, 1 / np.maximum(rank, 1), 0)
            return float((selection.feature_matrix(np.array([eta0]), eta, inverse, np.array([[c["retrieval_score"] for c in cands]]), np.array([chosen], int).reshape(1, -1))[0] @ weights + 0.1)[j])

        chosen, steps, reason = plain_choice(cands, score, 4, 1, -1.0)
        assert got[i]["selected_doc_ids"] == [cands[j]["doc_id"] for j in chosen] and got[i]["stop_reason"] == reason
        assert [s["predicted_score"] for s in got[i]["selection_steps"]] == pytest.approx([s[2] for s in steps])


def test_newton_and_network(spark):
    """The fit's gradient vanishes; the network's forward pass is what its layers say, and it learns what no line can."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0, 0.0])))).astype(int)
    df = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y, strict=True)], "features array<double>, is_best int").repartition(3)
    model = training.fit_selector(df, regularisation=0.5)
    p = 1 / (1 + np.exp(-(model.shift + x @ model.weights)))
    assert abs((y - p).sum()) < 1e-6 and np.abs(x.T @ (y - p) - 0.5 * np.array(model.weights)).max() < 1e-6
    for r in df.select("features", model.score(F.col("features")).alias("score")).limit(5).collect():
        assert r["score"] == pytest.approx(model.shift + float(np.dot(r["features"], model.weights)))
    xor = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(int)
    data = spark.createDataFrame([((3 * r + 5).tolist(), int(t)) for r, t in zip(x, xor, strict=True)], "features array<double>, is_best int").repartition(2)
    layers = training.fit_network(data, (12, 12), 60, 0.05)
    assert [w.shape for w, _ in layers] == [(3, 12), (12, 12), (12, 1)]
    scored = training.score_rows(data, lambda: selection.network_scorer(layers)).collect()
    for r in scored[:20]:
        v = np.array(r["features"])
        for k, (w, b) in enumerate(layers):
            v = np.array([sum(v[i] * w[i, j] for i in range(len(v))) + b[j] for j in range(w.shape[1])])
            v = np.maximum(v, 0) if k < len(layers) - 1 else v
        assert r["score"] == pytest.approx(v[0])
    assert np.mean([(r["score"] > 0) == r["is_best"] for r in scored]) > 0.9
    with pytest.raises(ValueError, match="both"):
        training.fit_network(data.where("is_best = 1"))


def test_limits_in_input_order(spark):
    """States of all rows count, groups only where they are kept; ties of ord go by id."""
    rng = np.random.default_rng(7)
    posts = spark.createDataFrame([(*r, int(rng.integers(-30, 30)) * 1000) for r in random_posteriors(8, 60)], DDL + ", ord long").repartition(3)
    teacher = setvalue.greedy_teacher(posts, 3, stop_below=0.02)
    order = sorted((r["ord"], r["id"], s["step"]) for r in teacher.collect() for s in r["steps"])
    kept = {(r["id"], r["step"]) for r in training.listwise_groups(teacher, posts).collect()}
    for n in (0, 1, 7, 50, 10_000):
        got = {(r["id"], r["step"]) for r in training.states(teacher, posts, n).collect()}
        assert got == {(i, s) for _, i, s in order[:n]}
        groups = {(r["id"], r["step"]) for r in training.listwise_groups(teacher, posts, max_groups=n).collect()}
        assert groups == {(i, s) for _, i, s in [o for o in order if o[1:] in kept][:n]}
    with pytest.raises(ValueError, match="ord"):
        training.states(teacher.drop("ord"), posts, 3)


def test_posterior_job_keeps_finished_buckets(spark, tmp_path):
    ddl = "id long, query string, label string, split string, candidates array<struct<doc_id:string,rank:int,score:double,title:string,text:string>>"
    rows = [(i, f"claim {i}.", "SUPPORTS", "dev", [{"doc_id": "a", "rank": 1, "score": 2.0, "title": None, "text": f"text {i}"}]) for i in range(40)]
    found, path, log = spark.createDataFrame(rows, ddl), f"file://{tmp_path}/posteriors", tmp_path / "asked"

    def scorer(broken):
        def make():
            def score(prompts):
                if broken and any("claim 17." in p for p in prompts):
                    raise RuntimeError("scorer broke")
                with log.open("a") as f:
                    f.writelines(p.split("Claim:\n")[1].split(".")[0] + "\n" for p in prompts)
                return digest_scorer()(prompts)

            return score

        return make

    with pytest.raises(Exception, match="scorer broke"):
        posterior.append_posteriors(found, path, scorer(True), LABELS, VERBALIZERS, buckets=8)
    done = {r["id"] for r in spark.read.parquet(path).collect()}
    assert 0 < len(done) < 40 and 17 not in done
    log.unlink()
    out = posterior.append_posteriors(found, path, scorer(False), LABELS, VERBALIZERS, buckets=8)
    assert sorted(r["id"] for r in out.collect()) == list(range(40))
    asked = log.read_text().split("\n")[:-1]
    assert sorted(asked) == sorted(2 * [f"claim {i}" for i in set(range(40)) - done])


def test_logits_hook(spark):
    prompts = spark.createDataFrame([(f"p{i}",) for i in range(9)], "prompt string").repartition(2)

    def make():
        return lambda texts, tokens: np.array([[len(t) + ord(x[-1]) % 7 + int(p[1:]) for x in tokens] for p, t in zip(texts, texts, strict=True)], float)

    verbalizers = {"A": ["A", " A", "A"], "B": ["B"]}
    for r in posterior.score_by_logits(prompts, make, ["A", "B"], verbalizers, batch_size=2).collect():
        z = np.array(make()([r["prompt"]], ["A", " A", "B"])[0])
        e = np.array([np.exp(z[:2]).sum(), np.exp(z[2])])
        assert r["logits"] == pytest.approx(z.tolist()) and r["probs"] == pytest.approx((e / e.sum()).tolist())
    for bad in (lambda: lambda t, k: np.full((len(t), len(k)), np.nan), lambda: lambda t, k: np.ones((len(t), 1))):
        with pytest.raises(Exception, match="finite logit"):
            posterior.score_by_logits(prompts, bad, ["A", "B"], verbalizers).collect()
    with pytest.raises(ValueError, match="verbalizer"):
        posterior.score_by_logits(prompts, make, ["A", "C"], verbalizers)
