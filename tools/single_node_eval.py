"""Single-process comparison point for the evaluation job: the same prediction
rows scored the way a pandas row loop does it (one process, one row at a time),
with the metric rules of lexigen.functions.metrics. Prints seconds.

    python tools/single_node_eval.py [sf_dir]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from lexigen.functions.metrics import rouge_l_summary, sentence_bleu  # noqa: E402
from lexigen.plans import oracle as O  # noqa: E402


def _sets(text: str, n: int):
    words = [w for p in text.split(".") if len(p) > 0 for w in " ".join(p.split()).split(" ")]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def rouge_n(ref: str, gen: str, n: int) -> float:
    h, r = _sets(gen, n), _sets(ref, n)
    o = len(h & r)
    p = o / len(h) if h else 0.0
    rc = o / len(r) if r else 0.0
    return 2.0 * ((p * rc) / (p + rc + 1e-8))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    df: pd.DataFrame = con.execute("WITH " + O.PREDS + " SELECT model, ref, gen FROM prep").df()
    t0 = time.perf_counter()
    rows = []
    for _, row in df.iterrows():
        ref, gen = str(row["ref"]).strip(), str(row["gen"]).strip()
        ok = bool([p for p in ref.split(".") if p]) and bool([p for p in gen.split(".") if p])
        rows.append({
            "model": row["model"],
            "EM": int(ref == gen),
            "BLEU": sentence_bleu(ref, gen),
            "ROUGE-1": rouge_n(ref, gen, 1) if ok else None,
            "ROUGE-2": rouge_n(ref, gen, 2) if ok else None,
            "ROUGE-L": rouge_l_summary(ref, gen) if ok else None,
        })
    detail = pd.DataFrame(rows)
    summary = detail.groupby("model").mean(numeric_only=True)
    dt = time.perf_counter() - t0
    print(f"rows={len(df)} seconds={dt:.2f}")
    print(summary.round(6).to_string())


if __name__ == "__main__":
    main()
