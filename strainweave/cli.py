"""Command line: run, validate, init, compare, benchmark, report, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from strainweave import config as cfg

TEMPLATE = {"project_name": "outbreak", "output_dir": "results", "inputs": {"snp_matrix": "snp_matrix.tsv", "epi_metadata": "epi.csv", "mlst_profiles": "mlst.csv"}, "thresholds": {"snp_cutoff": 20, "day_cutoff": 14}, "clustering": {"methods": list(cfg.METHODS), "bootstrap_n": 100, "random_state": 42}}


def _spark():
    from strainweave.session import local_session

    return local_session()


def _run(a) -> int:
    from strainweave.operators.summary import console_summary
    from strainweave.plans import pipeline

    r = pipeline.run(_spark(), cfg.from_yaml(a.config))
    console_summary(r.summary).orderBy("cluster_id").show(20, truncate=False)
    return 0


def _validate(a) -> int:
    from strainweave.sources import readers

    c = cfg.from_yaml(a.config)
    readers.load(_spark(), c.inputs.snp_matrix, c.inputs.epi_metadata, c.inputs.mlst_profiles)
    print("valid")
    return 0


def _init(a) -> int:
    import yaml

    if os.path.exists(a.path):
        print(f"{a.path} exists", file=sys.stderr)
        return 1
    with open(a.path, "w") as f:
        yaml.safe_dump(TEMPLATE, f, sort_keys=False)
    return 0


def _compare(a) -> int:
    for k, (x, y) in cfg.diff(cfg.from_yaml(a.first), cfg.from_yaml(a.second)).items():
        print(f"{k}: {x} -> {y}")
    return 0


def _benchmark(a) -> int:
    """Times the graph and the methods of a run on its own input."""
    from strainweave.operators import graph
    from strainweave.plans import pipeline
    from strainweave.plans.shared import cut
    from strainweave.sources import readers

    spark, c = _spark(), cfg.from_yaml(a.config)
    dist, iso = (cut(t, "input") for t in readers.load(spark, c.inputs.snp_matrix, c.inputs.epi_metadata, c.inputs.mlst_profiles))
    t, took = c.thresholds, {}
    began = time.time()
    e = cut(graph.edges(dist, iso, t.snp_cutoff, t.day_cutoff, t.edge_weight_alpha, t.edge_weight_beta, t.edge_weight_gamma), "edges")
    took["graph"] = round(time.time() - began, 3)
    for m in c.clustering.methods:
        began = time.time()
        pipeline.cluster_by(m, iso, e, c).count()
        took[m] = round(time.time() - began, 3)
    print(json.dumps({"isolates": iso.count(), "edges": e.count(), "seconds": took}))
    return 0


def _report(a) -> int:
    if not os.path.isdir(os.path.join(a.folder, "cluster_assignments")):
        print(f"{a.folder} is no folder of a run", file=sys.stderr)
        return 2
    from strainweave.plans import pipeline
    from strainweave.sources import writers

    t = pipeline.reload(_spark(), a.folder)
    with open(os.path.join(a.folder, "pipeline_summary.json")) as f:
        kpi = {k: v for k, v in json.load(f).items() if k.startswith("n_")}
    part = lambda df: writers.table_html(df.limit(201).collect(), df.columns)
    writers.write_report(os.path.join(a.folder, "report.html"), "Report", kpi, [(k.replace("_", " "), part(df)) for k, df in t.items()])
    return 0


def _serve(a) -> int:
    """Takes messages (JSON lines) that arrive in a folder until it is stopped."""
    from strainweave.operators import community, graph
    from strainweave.plans.shared import cut
    from strainweave.sources import readers
    from strainweave.streaming import incremental

    spark, c = _spark(), cfg.from_yaml(a.config)
    dist, iso = readers.load(spark, c.inputs.snp_matrix, c.inputs.epi_metadata, c.inputs.mlst_profiles)
    t = c.thresholds
    known = cut(iso.select("isolate_id", "collection_date", "sequence_type"), "known")
    edges = cut(graph.edges(dist, known, t.snp_cutoff, t.day_cutoff, t.edge_weight_alpha, t.edge_weight_beta, t.edge_weight_gamma), "known-edges")
    clusters = cut(community.leiden(known, edges, c.clustering.leiden_resolution).withColumnRenamed("community", "cluster"), "known-clusters")
    if not spark.sparkContext.master.startswith("local") and "://" not in c.output_dir:
        raise cfg.ConfigError("output_dir must name a file system that all executors share")
    incremental.follow(spark, a.messages, known, f"{c.output_dir}/stream", f"{c.output_dir}/stream-checkpoint", t.snp_cutoff, t.day_cutoff, known_edges=edges, known_clusters=clusters, threshold=c.streaming.alert_threshold).awaitTermination()
    return 0


def main(argv: list[str] | None = None) -> int:
    """Exit codes: 0 done, 1 the file is there already, 2 settings or input that cannot be used."""
    p = argparse.ArgumentParser(prog="strainweave")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, f, *args):
        s = sub.add_parser(name)
        s.set_defaults(f=f)
        for flags, kw in args:
            s.add_argument(*flags, **kw)

    command("run", _run, (["config"], {}))
    command("validate", _validate, (["config"], {}))
    command("init", _init, (["path"], {"nargs": "?", "default": "strainweave.yaml"}))
    command("compare", _compare, (["first"], {}), (["second"], {}))
    command("benchmark", _benchmark, (["config"], {}))
    command("report", _report, (["folder"], {}))
    command("serve", _serve, (["config"], {}), (["messages"], {}))
    a = p.parse_args(argv)
    try:
        return a.f(a)
    except cfg.ConfigError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
