"""The declared schemas of every table that the engine reads or writes."""

from __future__ import annotations

IMAGE = "struct<bytes: binary, path: string>"
UNIFIED = f"dataset string, qid string, image {IMAGE}, question string, answers array<string>, answer_type string"
PREDICTION = "qid string, prediction string, raw string, score double, answers array<string>"
RUN = (
    "run_id string, timestamp string, git_sha string, model struct<base: string, preset: string>, "
    "eval struct<dataset: string, subset: string, n: int, `limit`: int, prompt_template: string>, "
    "gen struct<backend: string, temperature: double, max_tokens: int, max_model_len: int>, "
    "metrics struct<overall: double, by_answer_type: map<string, double>>, config map<string, string>"
)
JUDGMENTS = "key string, verdict int, cost_usd double, created double"
STUDY = (
    "run_id string, em_accuracy double, sampled_misses int, judge_rescue_rate double, judge_corrected_accuracy double, "
    "control_agreement_on_em_hits double"
)
STREAM_EVENT = "model string, token string, done boolean, seq long"
