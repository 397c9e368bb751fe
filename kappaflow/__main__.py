"""Command line: the workflow's entry points as Spark jobs.

    python -m kappaflow embed      --data-dir DIR --out OUT   # stage 1: sentence vectors
    python -m kappaflow train      --data-dir DIR --out OUT   # stage 2: fit, test, reports
    python -m kappaflow end_to_end --data-dir DIR --out OUT   # first prompt, prompt as first sentence
    python -m kappaflow fine_tune  --data-dir DIR --out OUT   # first five rows' prompts, two variants

``DIR`` holds ``train.csv``, ``valid.csv`` and ``test.csv`` (or pass
``--essays`` with an ingested parquet essay table).  Results go under
``OUT``; ``OUT/runs`` gets one record per variant and experiment (A9).
"""

from __future__ import annotations

import argparse
import json
import os
import uuid

from kappaflow.operators.checks import quarantine, split_fingerprint
from kappaflow.operators.minibatch import MinibatchConfig
from kappaflow.operators.scorer import ScorerConfig
from kappaflow.plans import pipelines as PL
from kappaflow.schema import ESSAY_BATCH, VARIANTS
from kappaflow.session import build_session
from kappaflow.sources import essays as ES
from kappaflow.sources import sinks


def _essays(spark, args):
    if args.essays:
        return spark.read.parquet(args.essays)
    return ES.ingest_essays(spark, ES.split_paths(args.data_dir), os.path.join(args.out, "essays"), args.id_col)


def _revision(essays) -> str:
    rows = split_fingerprint(essays.drop("essay_id")).orderBy("split").collect()
    return json.dumps({r["split"]: [r["n_rows"], r["fingerprint"]] for r in rows}, sort_keys=True)


def parse(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="kappaflow")
    p.add_argument("command", choices=["embed", "train", "end_to_end", "fine_tune"])
    p.add_argument("--data-dir", default="./data")
    p.add_argument("--essays", default=None, help="parquet essay table instead of the CSV splits")
    p.add_argument("--id-col", default=None, help="column of the CSV splits that identifies an essay")
    p.add_argument("--out", required=True)
    p.add_argument("--dim", type=int, default=256)
    p.add_argument("--epochs", type=int, default=ScorerConfig.epochs)
    p.add_argument("--patience", type=int, default=ScorerConfig.patience)
    p.add_argument("--lr", type=float, default=ScorerConfig.lr)
    p.add_argument("--batch-size", type=int, default=None, help="training essays a batch; default: the command's own")
    p.add_argument("--whole-epochs", action="store_true", help="one gradient step per epoch instead of one per batch")
    p.add_argument("--previous", default=None, help="stored rubric_report of an earlier run, for the regression deltas")
    p.add_argument("--run-id", default=None, help="name of the run in the records; a rerun under it replaces them")
    p.add_argument("--n-exp", type=int, default=1)
    p.add_argument("--max-sentences", type=int, default=None, help="fine_tune: keep the first n sentences of every essay")
    p.add_argument("--master", default=None)
    return p.parse_args(argv)


def run(spark, args: argparse.Namespace) -> None:
    essays, bad = quarantine(_essays(spark, args))
    # rows that cannot be scored are kept, with a reason, next to the results
    bad.write.mode("overwrite").parquet(os.path.join(args.out, "quarantine"))
    common = {"lr": args.lr, "epochs": args.epochs, "patience": args.patience}
    cfg = ScorerConfig(**common) if args.whole_epochs else MinibatchConfig(
        **common, batch_size=args.batch_size or ESSAY_BATCH.get(args.command, ESSAY_BATCH["train"]))
    previous = spark.read.parquet(args.previous) if args.previous else None
    record = {"run_id": args.run_id or str(uuid.uuid4()), "entry_point": args.command, "commit": os.environ.get("GIT_COMMIT"),
              "data_revision": _revision(essays), "settings": {k: v for k, v in vars(args).items() if k not in ("out",)}}
    report = {"previous": previous, "record": record}
    emb_path = os.path.join(args.out, "emb")
    if args.command == "embed":
        PL.embedding_job(spark, essays, emb_path, dim=args.dim)
        sinks.write_run_records(spark, os.path.join(args.out, "runs"), [
            {**record, "variant": tag, "exp": 0, "output_path": emb_path} for tag, _ in VARIANTS])
    elif args.command == "train":
        vectors = PL.embedding_job(spark, essays, emb_path, dim=args.dim)
        PL.training_job(spark, essays, vectors, args.out, n_exp=args.n_exp, cfg=cfg, **report)
    elif args.command == "end_to_end":
        PL.end_to_end(spark, essays, args.out, dim=args.dim, cfg=cfg, **report)
    else:
        PL.fine_tune(spark, essays, args.out, dim=args.dim, cfg=cfg, max_sentences=args.max_sentences, **report)


def main(argv=None) -> None:
    args = parse(argv)
    spark = build_session(master=args.master)
    try:
        run(spark, args)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
