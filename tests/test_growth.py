"""What moves between tasks: rows that no query may shuffle, whatever the size of its tables."""

import numpy as np
import pytest

from premia.operators import covariance


def shuffled_rows(spark, plan):
    """Most rows that one stage of ``plan`` shuffles."""

    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    plan().write.format("noop").mode("overwrite").save()
    return max(n for number, n in stages().items() if number not in before)


def test_book_volatility_moves_weights_not_periods(spark):
    """300 books of 4 contracts over 90 periods: no row per book and period is shuffled, and the numbers are those of the dense form."""

    rng = np.random.default_rng(3)
    labels = [(0, "f1"), (0, "f2"), *[(1, f"c{i}") for i in range(4)]]
    y, scale = rng.normal(size=(90, 6)), rng.uniform(0.5, 2.0, 6)
    loading, weight = rng.normal(size=(4, 2)), rng.normal(size=(300, 4))
    joint = spark.createDataFrame(
        [("u", role, label, t, float(y[t, k]), float(scale[k])) for t in range(90) for k, (role, label) in enumerate(labels)],
        "universe_id string, role int, label string, period int, y double, scale double",
    )
    stats = spark.createDataFrame([("u", 90, 0.25, 0.9)], "universe_id string, n_obs long, shrinkage double, target_scale double")
    loadings = spark.createDataFrame(
        [("u", f"c{i}", f"f{k + 1}", float(loading[i, k])) for i in range(4) for k in range(2)],
        "universe_id string, contract_id string, factor string, loading double",
    )
    books = spark.createDataFrame(
        [("u", b, f"c{i}", float(weight[b, i])) for b in range(300) for i in range(4)],
        "universe_id string, book_id long, contract_id string, weight double",
    )
    plan = lambda: covariance.book_volatility(books, joint, stats, loadings)
    v = np.hstack([weight @ loading, weight]) * scale
    want = np.sqrt(0.75 / 90 * ((v @ y.T) ** 2).sum(axis=1) + 0.25 * 0.9 * (v**2).sum(axis=1))
    got = {row.book_id: row.volatility for row in plan().collect()}
    assert [got[b] for b in range(300)] == pytest.approx(want.tolist(), rel=1e-9)
    assert shuffled_rows(spark, plan) <= 300 * 4


def test_ranks_read_their_values_once(spark):
    """The ranks of tail_rank read no table of orders: averages evaluated twice may differ in their last bit, and their rows would not meet."""

    from premia.plans import catalog

    files = catalog()["tail_rank"].run(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("orders.parquet" in name for name in files)


def test_legs_are_dealt_by_their_number(spark, monkeypatch):
    """Large tables take more tasks than the session's own number, with the same legs and sums."""

    from premia.plans import audit
    from premia.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    order = ["book_id", "contract_id"]
    plain = [(r.book_id, r.contract_id, r.weight) for r in audit.legs(t).orderBy(*order).collect()]
    monkeypatch.setattr(audit, "LEGS_A_TASK", 1000)
    books = audit.legs(t)
    assert [(r.book_id, r.contract_id, r.weight) for r in books.orderBy(*order).collect()] == plain
    dealt = audit.dealt(books)
    assert dealt.count() == len(plain) and dealt.rdd.getNumPartitions() == -(-len(plain) // 1000) > 4


def shuffled_bytes(spark, plan):
    """Bytes that all stages of ``plan`` shuffle."""

    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    plan().write.format("noop").mode("overwrite").save()
    return sum(n for number, n in stages().items() if number not in before)


@pytest.mark.parametrize("step", ["sums", "tails"])
def test_what_legs_send_does_not_grow_with_the_tasks(spark, step):
    """Sums of a book's legs in each task combine less and less as contracts are dealt over more tasks; cells sent once a leg stay as many."""

    from premia.operators import audit

    rng = np.random.default_rng(9)
    cells = [(int(k), c, float(rng.normal())) for c in range(300) for k in rng.choice(84, 25, replace=False)]
    legs = [(b, int(c), float(rng.normal())) for b in range(200) for c in rng.choice(300, 16, replace=False)]
    scenarios = spark.createDataFrame(cells, "scenario_id int, contract_id int, ret double")
    rows = spark.createDataFrame(legs, "book_id int, contract_id int, weight double")
    costs = spark.createDataFrame([(b, 0.0) for b in range(200)], "book_id int, cost double")
    plans = {"sums": lambda: audit.scenario_sums(rows, scenarios), "tails": lambda: audit.scenario_cvar(rows, scenarios, costs, 0.95)}
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sent = []
        for tasks in (1, 8):
            spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
            sent.append(shuffled_bytes(spark, plans[step]))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sent[1] < 1.4 * sent[0], sent


def test_a_written_table_leaves_no_shuffle_files(spark):
    """What a step has shuffled is gone when its table is written; else a query's disk holds all of its steps together."""

    import time

    from premia.session import written

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    before = shuffles()
    table = written(spark.range(20_000).repartition(7, "id"), "dealt")
    for _ in range(50):
        left = shuffles() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and table.count() == 20_000


def test_monthly_decisions_meet_cells_of_books_that_pass_the_rest(spark, monkeypatch):
    """Books that a limit other than the tail loss rules out are no candidates; their legs meet no scenario cells."""

    from premia.operators import audit
    from premia.plans import catalog

    met, tails, sound, rounds = [], audit.tail_losses, [], audit.book_rounds

    def dealt(*args):
        parts = rounds(*args)
        sound.append(sum(part.select("book_id").distinct().count() for part in parts))
        return parts

    def lost(rows, *rest):
        met.append(rows.select("book_id").distinct().count())
        return tails(rows, *rest)

    monkeypatch.setattr(audit, "book_rounds", dealt)
    monkeypatch.setattr(audit, "tail_losses", lost)
    catalog()["monthly_decisions"].run(spark, "/root/testdata/sf0.001")
    assert sound[0] > 0 and met[0] < sound[0] / 2
