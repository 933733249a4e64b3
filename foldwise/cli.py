"""Command line: the experiment steps as Spark jobs (run with spark-submit or python -m).

  build     raw CSVs -> processed tables (variant + folds for every seed)
  train     fit every (seed, fold) model, OOF, scores -> metrics log
  infer     fold ensemble of one seed on the test set -> submission CSV
  pseudo    corpus folder minus train -> pseudo labels per (seed, fold)
  pretrain  pseudo-label pretraining + fine-tuning -> metrics log
"""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from foldwise.config import LOSSES, RunConfig


def _cfg(a) -> RunConfig:
    return RunConfig(run_name=a.run_name, data_version=a.data_version, pooling=a.pooling,
                     seeds=tuple(a.seeds), debug=a.debug, n_features=a.n_features, loss=a.loss)


def _raw(spark, a):
    from foldwise.sources import csv
    return (csv.read_train(spark, a.train), csv.read_test(spark, a.test),
            csv.read_sample_submission(spark, a.sample_submission))


def main(argv=None) -> dict:
    p = argparse.ArgumentParser(prog="foldwise")
    p.add_argument("step", choices=["build", "train", "infer", "pseudo", "pretrain"])
    p.add_argument("--train", required=True, help="raw train CSV (text_id, full_text, targets)")
    p.add_argument("--test", help="raw test CSV (text_id, full_text)")
    p.add_argument("--sample-submission", dest="sample_submission", help="sample submission CSV")
    p.add_argument("--corpus", help="folder of *.txt files (pseudo, pretrain)")
    p.add_argument("--out", required=True, help="output root (shared storage)")
    p.add_argument("--run-name", dest="run_name", default="baseline")
    p.add_argument("--data-version", dest="data_version", default="vanilla")
    p.add_argument("--pooling", default="mean")
    p.add_argument("--loss", default="smooth_l1", choices=LOSSES)
    p.add_argument("--seeds", type=int, nargs="+", default=[42, 43, 44])
    p.add_argument("--seed", type=int, default=42, help="seed whose fold models predict the test set")
    p.add_argument("--n-features", dest="n_features", type=int, default=128)
    p.add_argument("--debug", action="store_true")
    p.add_argument("--master", default=None)
    a = p.parse_args(argv)

    from foldwise.plans import jobs
    from foldwise.session import build_session
    from foldwise.sources import processed
    from foldwise.sources.corpus import read_text_corpus

    spark = build_session(a.master)
    cfg = _cfg(a)
    out = a.out.rstrip("/")
    from foldwise.sources.csv import read_train
    train = read_train(spark, a.train)
    result: dict = {"step": a.step}
    if a.step == "build":
        _, test, template = _raw(spark, a)
        jobs.build_dataset_bundle(train, test, template, f"{out}/processed", a.data_version, cfg.seeds)
        result["tables"] = f"{out}/processed"
    elif a.step in ("train", "pretrain"):
        if a.step == "train":
            coefs, oof, scores, log = jobs.run_experiment(spark, train, cfg)
        else:
            corpus = read_text_corpus(spark, a.corpus).select("text_id", "full_text")
            coefs, oof, scores, log = jobs.pretrain_finetune(spark, train, corpus, cfg)
        processed.write_table(oof, out, f"oof/{cfg.run_name}", partition_cols=("seed",))
        processed.append_metrics(log, f"{out}/runs")
        processed.append_params(spark, jobs.params_log(cfg), f"{out}/runs")
        result["scores"] = [r.asDict() for r in scores.orderBy("seed").collect()]
    elif a.step == "infer":
        _, test, template = _raw(spark, a)
        cfg = replace(cfg, seeds=(a.seed,))
        coefs, _ = jobs.fit_run(spark, jobs._featurized_folds(spark, train, cfg), cfg)
        jobs.inference(spark, test, coefs, template, f"{out}/submission", cfg, seed=a.seed)
        result["submission"] = f"{out}/submission"
    elif a.step == "pseudo":
        corpus = read_text_corpus(spark, a.corpus).select("text_id", "full_text")
        jobs.write_pseudo_tables(spark, train, corpus, f"{out}/processed", model="ridge", seeds=cfg.seeds, cfg=cfg)
        result["tables"] = f"{out}/processed"
    print(json.dumps(result, default=str))
    return result


if __name__ == "__main__":
    main()
