"""Recovery of flows against a simulation that takes one failure after the other, as one flow at a time would."""

import random

import pytest
from pyspark.sql import functions as F

from flowsift.operators import recovery as R
from flowsift.operators import retries as T

ATOMS = "flow long, atom long, kind string, owner long, pos int, state string, intention string, failure string, extra int"
HISTORIES = "retry long, history array<struct<value:string,failures:map<string,string>>>, most int, give_up string, noted int"


def world(rng, flows=30, size=14):
    """Flows of nested retries; a retry comes before all that it encloses, further edges go forward."""
    atoms, edges, histories = [], [], []
    for flow in range(flows):
        owners = [None]
        for pos in range(1, rng.randrange(2, size)):
            atom = flow * 100 + pos
            kind = rng.choice(["task", "task", "task", "retry", "retry", "flow"])
            owner = rng.choice(owners[-3:])
            if kind == "retry":
                owners.append(atom)
            failed = kind != "flow" and rng.random() < 0.35
            state = "FAILURE" if failed else rng.choice(["SUCCESS", "SUCCESS", "SUCCESS", "PENDING", "REVERTED", "IGNORE"] + ["RUNNING"] * (rng.random() < 0.3))
            atoms.append((flow, atom, kind, owner, pos, state, rng.choice(["EXECUTE"] * 6 + ["REVERT", "IGNORE"]), rng.choice("XYZ") if failed else None, 1))
            if owner is not None:
                edges.append((owner, atom))
            for _ in range(rng.randrange(2)):
                if pos > 1:
                    edges.append((flow * 100 + rng.randrange(1, pos), atom))
            if kind == "retry" and rng.random() < 0.95:
                n = rng.choice([0, 1, 1, 2, 3])
                history = [(f"v{i}", {str(flow * 100 + rng.randrange(1, size)): "W"} if rng.random() < 0.4 else {}) for i in range(n)]
                histories.append((atom, history, rng.randrange(1, 5), rng.choice(["REVERT", "REVERT", "REVERT_ALL"]), rng.randrange(1, 4)))
    return atoms, sorted(set(edges)), histories


def simulated(atoms, edges, histories, defer):
    kind, owner, flow = ({a[1]: a[i] for a in atoms} for i in (2, 3, 0))
    state, intention = ({a[1]: a[i] for a in atoms} for i in (5, 6))
    real = lambda a: kind[a] != "flow"
    book = {h[0]: ([(v, dict(f)) for v, f in h[1]], *h[2:]) for h in histories}
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)

    def behind(a):
        seen, todo = set(), list(after.get(a, []))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, [])
        return seen

    def decide(retry, asker, failure):
        history, most, give_up, noted = book[retry]
        failures = history[-1][1]
        failures.setdefault(str(asker), failure)
        return "RETRY" if len(history) < most and len(failures) <= noted else give_up

    class Missing(Exception):
        pass

    def ask(asker, retry, failure):
        """(action, at); a default answer has no given mark."""
        if retry is None:
            return "REVERT_ALL", None, False
        if retry not in book or not book[retry][0]:
            raise Missing
        d = decide(retry, asker, failure)
        if d == "RETRY":
            return "RETRY", retry, True
        if d == "REVERT_ALL":
            return "REVERT_ALL", None, True
        outer = ask(retry, owner[retry], failure)
        if defer or outer[2] and outer[0] != "REVERT":
            return outer
        return "REVERT", retry, True

    def put(a, what):
        if not (what == "RETRY" and intention[a] == "REVERT") and real(a):
            intention[a] = what

    answers = {}
    for _, a, k, o, _, s, _, failure, _ in sorted(atoms, key=lambda a: (a[4], a[1])):
        if s != "FAILURE" or k == "flow":
            continue
        try:
            action, at, _ = ask(a, o, failure)
        except Missing:
            answers[a] = (None, None, "NO_ATTEMPT")
            continue
        answers[a] = (action, at, None)
        if action == "REVERT_ALL":
            [put(x, "REVERT") for x in kind if flow[x] == flow[a]]
        else:
            put(at, action)
            [put(x, "REVERT") for x in behind(at)]
    changed = True
    while changed:
        changed = False
        for a in state:
            fine = all(state[x] in ("PENDING", "REVERTED", "IGNORE") for x in behind(a) if real(x))
            if real(a) and state[a] in ("SUCCESS", "FAILURE") and intention[a] in ("REVERT", "RETRY") and fine:
                changed = True
                state[a] = "REVERTED" if intention[a] == "REVERT" else "RETRYING"
    for a in [a for a in state if state[a] == "RETRYING"]:
        intention[a] = "EXECUTE"
        for x in behind(a):
            if real(x):
                state[x], intention[x] = "PENDING", "EXECUTE"
    rows = {r: [] if state[r] == "REVERTED" else h[0] for r, h in book.items()}
    return answers, {a: (state[a], intention[a]) for a in state}, rows


@pytest.mark.parametrize("seed, defer", [(1, False), (2, True), (3, False)])
def test_tables_after_failures(spark, seed, defer):
    rng = random.Random(seed)
    atoms, edges, histories = world(rng)
    decide = lambda history, asker, failure, nth: F.when((F.size(history) < F.col("most")) & (nth <= F.col("noted")), "RETRY").otherwise(F.col("give_up"))
    after, books, answers = R.recover(spark.createDataFrame(atoms, ATOMS), spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(histories, HISTORIES), decide, defer)
    want = simulated(atoms, edges, histories, defer)
    assert {r.atom: (r.action, r["at"], r.problem) for r in answers.collect()} == want[0]
    assert {r.atom: (r.state, r.intention) for r in after.collect()} == want[1]
    assert {r.retry: [(x.value, dict(x.failures)) for x in r.history] for r in books.collect()} == want[2]
    assert {a for a, *_ in want[0].values()} >= {"RETRY", "REVERT", "REVERT_ALL"} or defer


def test_recovery_of_tables_without_failures_or_retries(spark):
    none = spark.createDataFrame([], HISTORIES)
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    for rows, want in (([], []), ([(1, 1, "task", None, 1, "SUCCESS", "EXECUTE", None, 1), (1, 2, "task", None, 2, "PENDING", "EXECUTE", None, 1)], [(1, "SUCCESS", "EXECUTE"), (2, "PENDING", "EXECUTE")]),
                       ([(1, 1, "task", None, 1, "SUCCESS", "EXECUTE", None, 1), (1, 2, "task", 9, 2, "FAILURE", None, "X", 1)], [(1, "REVERTED", "REVERT"), (2, "REVERTED", "REVERT")])):
        after, books, _ = R.recover(spark.createDataFrame(rows, ATOMS), edges, none, R.times_decision(3))
        assert sorted(map(tuple, after.collect())) == want and books.collect() == []


def test_one_retry_asked_by_very_many(spark, monkeypatch):
    from flowsift.operators import graphs

    monkeypatch.setattr(graphs, "HOT", 20)
    atoms = [(1, 1, "retry", None, 1, "SUCCESS", "EXECUTE", None, 1)] + [(1, i, "task", 1, i, "FAILURE", "EXECUTE", "X", 1) for i in range(2, 200)]
    decide = lambda history, asker, failure, nth: F.when(nth <= 150, "RETRY").otherwise("REVERT")
    after, books, answers = R.recover(spark.createDataFrame(atoms, ATOMS), spark.createDataFrame([(1, i) for i in range(2, 200)], "src long, dst long"), spark.createDataFrame([(1, [("v", {})], 1, "", 1)], HISTORIES), decide)
    got = {r.atom: r.action for r in answers.collect()}
    assert all(got[i] == ("RETRY" if i <= 151 else "REVERT") for i in range(2, 200)) and len(got) == 198
    assert books.collect()[0].history == [] and {r.state for r in after.collect()} == {"REVERTED"}


def test_outcomes_causes_and_resets(spark):
    kind = "array<struct<value:string,failures:map<string,string>>>"
    df = spark.createDataFrame([(1, [("a", {"x": "E"}), ("b", {}), ("c", {"x": "F", "y": "E"})], "G"), (2, [], None), (3, None, "G")], f"flow long, results {kind}, own string")
    got = {r[0]: r[1:] for r in df.select("flow", T.outcomes(F.col("results")), T.outcomes(F.col("results"), 3), T.caused_by(F.col("results"), "G"), T.caused_by(F.col("results"), "G", own=F.col("own"))).collect()}
    assert sorted(map(tuple, got[1][0])) == [("x", "E"), ("x", "F"), ("y", "E")] and len(got[1][1]) == 2
    assert got[1][2:] == (False, True) and got[2] == ([], [], False, False) and got[3] == (None, None, False, True)
    atoms = spark.createDataFrame([("a", "retry", "SUCCESS", "REVERT", ["1"], "F"), ("b", "task", "FAILURE", "EXECUTE", ["2"], None), ("c", "retry", "PENDING", "RETRY", ["3"], None)], "name string, kind string, state string, intention string, results array<string>, revert_failure string")
    assert [tuple(r) for r in T.reset_atoms(atoms).orderBy("name").collect()] == [("a", "retry", "PENDING", "EXECUTE", [], None), ("b", "task", "PENDING", "EXECUTE", None, None), ("c", "retry", "PENDING", "RETRY", ["3"], None)]
