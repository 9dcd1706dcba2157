"""Explicit schemas for the JSON-lines record types of the workload (use with
:func:`reasonloop.sources.jsonl.read_jsonl`). ``id`` is a string everywhere: one file type
stores it as a number, the JSON reader keeps its text. ``em`` is a nullable int where it
is 0/1/null and a boolean where the file stores a boolean."""

# Field names of the record types.
PROBLEM_RAW = "id string, question string, answer string"
TRAIN_SAMPLE = "id string, question string, gold_answer string, gold_rationale string, text string"
ZERO_SHOT_PREDICTION = ("id string, question string, generated string, rationale string, answer string, "
                        "gold string, gold_extracted string, em int")
BATCHED_EVAL_PREDICTION = "id string, em boolean, gold_answer string, output string"
SAMPLED_EVAL_PREDICTION = ("id string, question string, output string, pred_final string, "
                           "gold_answer string, em boolean")
KEPT_RATIONALE = "id string, question string, rationale string, final string"
RETRY_ROW = "id string, question string, gold_answer string, output string, em_after boolean"
SFT_TRIPLE = "id string, question string, rationale string, answer string"
SFT_TEXT = "id string, text string"
KEPT_ROW = "id bigint, question string, rationale string, final string, cand_idx int"
