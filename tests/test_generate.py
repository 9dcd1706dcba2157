"""Caller-supplied generators through mapInPandas, and stored generations."""

from reasonloop.operators.generate import TableGenerator, generate


def echo_generator(prompts, k):
    return [[f"{p} -> {j}" for j in range(k)] for p in prompts]


def test_callable_generator(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "id bigint, prompt string").repartition(3)
    out = generate(prompts, echo_generator, k=2, batch_size=7)
    rows = sorted((r.id, r.cand_idx, r.text) for r in out.collect())
    assert len(rows) == 100 and rows[0] == (0, 1, "p0 -> 0") and rows[1] == (0, 2, "p0 -> 1")


def test_errors_recorded(spark):
    def boom(prompts, k):
        raise RuntimeError("no model")
    prompts = spark.createDataFrame([(1, "a")], "id bigint, prompt string")
    rows = generate(prompts, boom, k=2, on_error="record").collect()
    assert len(rows) == 2 and all(r.text is None and "no model" in r.error for r in rows)


def test_table_generator(spark):
    gens = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "id bigint, cand_idx int, text string")
    prompts = spark.createDataFrame([(1, "p"), (3, "q")], "id bigint, prompt string")
    rows = sorted(tuple(r) for r in generate(prompts, TableGenerator(gens), k=1).collect())
    assert rows == [(1, 1, "x", None)]


def test_loader_builds_generator_once_per_worker(spark):
    def loader():
        prefix = "loaded"
        return lambda prompts, k: [[f"{prefix}:{p}"] * k for p in prompts]
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "id bigint, prompt string")
    rows = generate(prompts, None, k=1, loader=loader).collect()
    assert sorted(r.text for r in rows)[0] == "loaded:p0" and len(rows) == 20


def test_each_loader_gives_its_own_text(spark):
    prompts = spark.createDataFrame([(i, "p") for i in range(4)], "id long, prompt string")
    for n in range(12):
        def loader(n=n):
            return lambda texts, k: [[f"model {n}"] * k for _ in texts]
        got = {r.text for r in generate(prompts, None, k=1, loader=loader).collect()}
        assert got == {f"model {n}"}


def test_iteration_runs_with_a_callable_at_defaults(spark):
    from reasonloop.plans.iteration import run_iteration
    problems = spark.createDataFrame([(1, "q", "#### 2")], "id long, question string, answer string")
    r = run_iteration(problems, lambda t, k: [["#### 2"] * k for _ in t], lambda t, k: [["#### 2"] * k for _ in t])
    assert r.forward.count() == 1
