"""Command-line tasks over small JSON-lines files."""

import json
import os
import tempfile

from reasonloop import cli


def _write(path, rows):
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def test_rescore_compare_build_check(spark, capsys):
    d = tempfile.mkdtemp(prefix="rl-cli-")
    preds = os.path.join(d, "preds.jsonl")
    _write(preds, [
        {"id": 1, "question": "q1", "generated": "so the answer is 18.", "answer": "18", "gold": "x\n#### 18", "em": 1},
        {"id": 2, "question": "q2", "generated": "I get 5", "answer": "5", "gold": "<<16-3-4=9>>9\n#### 18", "em": 0},
        {"id": 3, "question": "q3", "generated": "#### 7", "answer": "7", "gold": "", "em": None},
    ])
    rows = {r.id: r for r in cli.rescore(spark, preds).collect()}
    # an empty gold falls through the ``gold or answer`` chain to the stored answer
    assert (rows["1"].em, rows["2"].em, rows["3"].em) == (1, 0, 1)
    first = {r.id: r.em for r in cli.rescore(spark, preds, "cascade_first").collect()}
    assert first == {"1": 1, "2": 0, "3": 1}     # "=" comes first: gold 2 extracts 9
    cmp = {r.label: r for r in cli.compare(spark, [f"A:{preds}"]).collect()}
    assert (cmp["A"].total, cmp["A"].n_gold, cmp["A"].correct, cmp["A"].parse_ok) == (3, 2, 1, 1)

    fw, rt = os.path.join(d, "fw.jsonl"), os.path.join(d, "rt.jsonl")
    _write(fw, [{"id": "a", "question": "qa", "rationale": "ra", "final": "1"},
                {"id": "b", "question": "qb", "rationale": "rb", "final": "2"}])
    _write(rt, [{"id": "a", "question": "qa", "rationale": "ra2", "final": "1"}])
    out = os.path.join(d, "train")
    assert cli.main(["build", "--forward", fw, "--rationalized", rt, "--out", out]) == 0
    assert cli.main(["check-format", out]) == 0
    printed = capsys.readouterr().out
    assert '"written": 2' in printed and '"ok": 2' in printed


def test_check_format_quarantine(spark, capsys):
    d = tempfile.mkdtemp(prefix="rl-cli-")
    train = os.path.join(d, "train.jsonl")
    _write(train, [{"id": "a", "text": "###Input:\nq\n\n###Output:\nr\n#### 1"}, {"id": "b", "text": "plain"}])
    assert cli.main(["check-format", train, "--quarantine", os.path.join(d, "bad")]) == 0
    assert '"bad": 1' in capsys.readouterr().out


def test_build_order_over_several_files(spark):
    """The last row in file order wins, whatever the sizes of the files."""
    d = tempfile.mkdtemp(prefix="rl-cli-")
    fw = os.path.join(d, "fw")
    os.mkdir(fw)
    row = {"id": "a", "question": "q", "rationale": "early", "final": "1"}
    _write(os.path.join(fw, "part-00000.json"), [row, {**row, "rationale": "inside"}])
    _write(os.path.join(fw, "part-00001.json"),
           [{**row, "id": f"x{i}", "rationale": "r" * 200} for i in range(50)] + [{**row, "rationale": "late"}])
    got = {r.id: r.text for r in cli.build(spark, fw, os.path.join(d, "absent.jsonl")).collect()}
    assert len(got) == 51 and "late" in got["a"]


def test_regroup_flat_is_positional(spark):
    from reasonloop.operators import selection as S
    texts = [f"t{i}" for i in range(12)]
    flat = spark.createDataFrame(list(enumerate(texts)), "pos long, text string")
    got = {(r.prompt_idx, r.cand_idx): r.text for r in S.regroup_flat(flat, 4).collect()}
    assert got == {(j, i + 1): texts[j * 4:(j + 1) * 4][i] for j in range(3) for i in range(4)}
