import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from strainweave import cli, config
from strainweave.operators import consensus, hamming
from strainweave.plans import pipeline
from strainweave.sources import readers, writers
from strainweave.streaming import incremental
from tests.fixture import write_fixture


@pytest.fixture(scope="module")
def fixture(tmp_path_factory):
    return write_fixture(str(tmp_path_factory.mktemp("fixture")))


def settings(fixture, out, **clustering):
    return config.from_dict({"project_name": "t", "output_dir": str(out), "inputs": {"snp_matrix": fixture["snp_matrix.tsv"], "epi_metadata": fixture["epi.csv"], "mlst_profiles": fixture["mlst.csv"]}, "thresholds": {"snp_cutoff": 20, "day_cutoff": 30}, "clustering": clustering})


def test_whole_run(spark, fixture, tmp_path):
    c = settings(fixture, tmp_path / "out", bootstrap_n=3)
    r = pipeline.run(spark, c)
    truth = spark.read.csv(fixture["truth.csv"], header=True).select("isolate_id", F.col("true_cluster").cast("long").alias("label"))
    assert consensus.adjusted_rand(r.clusters.withColumnRenamed("cluster_id", "label"), truth).first().ari > 0.85
    assert r.centrality.count() == 28 and r.index_cases.count() == r.summary.count()
    for name in ("cluster_assignments", "centrality_scores", "index_case_candidates", "bootstrap_stability", "cluster_stability_summary", "clusters", "transmission_graph.graphml", "transmission_dag.graphml", "report.html", "pipeline_summary.json", "graph_summary.json", "dag_summary.json"):
        assert os.path.exists(tmp_path / "out" / name), name
    with open(tmp_path / "out/pipeline_summary.json") as f:
        assert json.load(f)["n_isolates"] == 28
    back = pipeline.reload(spark, str(tmp_path / "out"))
    assert back["cluster_assignments"].count() == 28 and set(back["cluster_assignments"].columns) == {"isolate_id", "snp_chains", "leiden", "spectral", "consensus", "agreement_score", "ambiguous"}
    for name in ("transmission_graph", "transmission_graph.graphml"):
        iso, edges = writers.load_graph(spark, str(tmp_path / "out" / name))
        rows = lambda df, like: sorted(map(str, df.select(*[F.col(c).cast("string") for c in sorted(like.columns)]).collect()))
        assert rows(iso, r.isolates) == rows(r.isolates, r.isolates) and rows(edges, r.edges) == rows(r.edges, r.edges)
    writers.zip_results(str(tmp_path / "out"), str(tmp_path / "all.zip"))
    assert os.path.getsize(tmp_path / "all.zip") > 1000
    assert cli.main(["report", str(tmp_path)]) == 2


def write(path, text):
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize(
    ("text", "message"),
    [("", "empty"), ("id\n", "empty"), ("id,A,B\nA,0,1\n", "square"), ("id,A,B\nA,0,1\nB,1\n", "square"), ("id,A,B\nA,0,1\nC,1,0\n", "differ"), ("id,A,B\nA,0,x\nB,1,0\n", "not a number"), ("id,A,B\nA,0,\nB,1,0\n", "missing"), ("id,A,B\nA,0,-1\nB,-1,0\n", "negative"), ("id,A,B\nA,1,2\nB,2,0\n", "diagonal"), ("id,A,B\nA,0,3\nB,5,0\n", "asymmetric")],
)
def test_matrix_errors(spark, tmp_path, text, message):
    with pytest.raises(readers.IngestionError, match=message):
        readers.read_matrix(spark, write(tmp_path / "m.csv", text))


def test_readers(spark, tmp_path):
    with pytest.raises(readers.IngestionError, match="not found"):
        readers.read_matrix(spark, str(tmp_path / "none.csv"))
    m = readers.read_matrix(spark, write(tmp_path / "m.tsv", 'snp-dists 0.8\t001\t"002"\n001\t0\t7\n002\t7\t0\n'))
    assert [tuple(r) for r in m.collect()] == [("001", "002", 7.0, 0, 1)]
    epi = readers.read_epi(spark, write(tmp_path / "e.csv", "Isolate_ID;Collection_Date;FACILITY;ward\n001;1/2/2020;;NICU\n001;2020/2/3; F ;\n"))
    assert [(r.isolate_id, str(r.collection_date), r.facility, r.ward) for r in epi.collect()] == [("001", "2020-02-03", "F", "unknown")]
    for bad, message in (("isolate_id,collection_date,facility\nA,2020-1-1,f\n", "ward"), ("isolate_id,collection_date,facility,ward\nA,soon,f,w\n", "cannot be read"), ("isolate_id,collection_date,facility,ward\nA,2999-1-1,f,w\n", "future")):
        with pytest.raises(readers.IngestionError, match=message):
            readers.read_epi(spark, write(tmp_path / "bad.csv", bad))
    mlst = readers.read_mlst(spark, write(tmp_path / "s.csv", "isolate_id,ST,gapA\n001,ST38,1\n002,,2\n"))
    assert sorted(tuple(r) for r in mlst.collect()) == [("001", "38"), ("002", "novel")]
    (tmp_path / "fa").mkdir()
    write(tmp_path / "fa/a.fasta", ">A first\nacgt\nACGT\n\n>B\nTTTT\n")
    write(tmp_path / "fa/b.fa", "ACGTACGA\n")
    seqs = readers.read_fasta(spark, str(tmp_path / "fa"))
    assert sorted(tuple(r) for r in seqs.collect()) == [("A", "ACGTACGT"), ("b", "ACGTACGA")]
    for _ in range(2):
        d = writers.cached_distances(spark, seqs, str(tmp_path / "cache"), lambda s: hamming.close_sequences(s, 3))
        assert [tuple(r) for r in d.collect()] == [("A", "b", 1)]
    assert len(os.listdir(tmp_path / "cache")) == 1
    with pytest.raises(readers.IngestionError, match="without metadata: 002"):
        readers.load(spark, str(tmp_path / "m.tsv"), str(tmp_path / "e.csv"))


def test_settings(tmp_path, fixture):
    c = settings(fixture, tmp_path)
    c.to_yaml(str(tmp_path / "c.yaml"))
    assert config.from_yaml(str(tmp_path / "c.yaml")) == c
    d = settings(fixture, tmp_path, random_state=7)
    assert config.diff(c, d) == {"clustering.random_state": (42, 7)}
    for wrong in ({"thresholds": {"edge_weight_alpha": 0.9}}, {"clustering": {"methods": ["other"]}}, {"unknown": 1}, {"thresholds": {"snp_cutoff": -1}}):
        with pytest.raises(config.ConfigError):
            config.from_dict({"project_name": "t", "output_dir": "o", "inputs": {"snp_matrix": "a", "epi_metadata": "b"}} | wrong)
    for text in ("", "a: [", "project_name: t\noutput_dir: o\ninputs: {snp_matrix: /none, epi_metadata: /none}\n"):
        with pytest.raises(config.ConfigError):
            config.from_yaml(write(tmp_path / "w.yaml", text))
    with pytest.raises(config.ConfigError):
        config.from_yaml(str(tmp_path / "none.yaml"))
    assert cli.main(["run", str(tmp_path / "none.yaml")]) == 2
    assert cli.main(["init", str(tmp_path / "new.yaml")]) == 0 and cli.main(["init", str(tmp_path / "new.yaml")]) == 1


def test_messages_as_a_stream(spark, tmp_path):
    known = spark.createDataFrame([("A", "2020-01-01", "1"), ("B", "2020-01-20", None)], "isolate_id string, d string, sequence_type string").select("isolate_id", F.col("d").cast("date").alias("collection_date"), "sequence_type")
    (tmp_path / "in").mkdir()
    message = lambda k, i, day, near, st="ST2": json.dumps({"row_id": k, "isolate_id": i, "collection_date": day, "sequence_type": st, "snp_distances": near})
    write(tmp_path / "in/1.json", "\n".join([message(1, "C", "2020-01-05", {"A": 5.5, "B": 21, "Z": 1}), message(2, "A", "2020-01-05", {"B": 1}), message(3, "C", "2020-01-06", {"B": 1})]))
    os.utime(tmp_path / "in/1.json", (1, 1))
    write(tmp_path / "in/2.json", "\n".join([message(4, "D", "18/01/2020", {" C ": 2, "B": 3, "A": 1}, None), message(5, "C", "2020-01-06", {"B": 1}), message(6, "E", "?", {"A": 1})]))
    none = spark.createDataFrame([], "src string, dst string, composite_weight double")
    before = known.select("isolate_id", F.col("isolate_id").alias("cluster"))
    out = str(tmp_path / "out")
    incremental.follow(spark, str(tmp_path / "in"), known, out, str(tmp_path / "cp"), files_per_batch=1, once=True, known_edges=none, known_clusters=before).awaitTermination()
    e = spark.read.parquet(f"{out}/edges").drop("batch")
    assert sorted((r.source, r.target, r.snp_distance, r.day_delta, r.mlst_mismatch) for r in e.collect()) == [("C", "A", 6, 4, True), ("D", "B", 3, 2, False), ("D", "C", 2, 13, False)]
    u = {r.isolate_id: r for r in spark.read.parquet(f"{out}/updates").collect()}
    assert (u["C"].centrality_score, u["C"].cluster, u["C"].new_cluster_formed, u["C"].transmission_alert) == (0.0, "A", False, False)
    assert u["D"].centrality_score == 1.0 and u["D"].transmission_alert
    assert [r.isolate_id for r in spark.read.parquet(f"{out}/alerts").collect()] == ["D"]
    assert incremental.status(spark.read.parquet(f"{out}/isolates"), e, spark.read.parquet(f"{out}/clusters/batch=1")).first().n_edges == 3


def test_edges_between_messages_of_one_batch(spark, tmp_path):
    known = spark.createDataFrame([("A", "2020-01-01", "1")], "isolate_id string, d string, sequence_type string").select("isolate_id", F.col("d").cast("date").alias("collection_date"), "sequence_type")
    near = {1: ("C", {"A": 5, "D": 3}), 2: ("D", {" C ": 2, "A": 30}), 3: ("E", {"D": 4, "C": 21, "E": 0}), 4: ("F", {"E": 1, "A": 2})}
    rows = [json.dumps({"row_id": k, "isolate_id": i, "collection_date": "2020-01-05", "sequence_type": "1", "snp_distances": d}) for k, (i, d) in near.items()]
    want = [("C", "A", 5), ("D", "C", 2), ("E", "D", 4), ("F", "A", 2), ("F", "E", 1)]
    for files in ([rows], [rows[:2], rows[2:]]):
        at = tmp_path / str(len(files))
        (at / "in").mkdir(parents=True)
        for k, lines in enumerate(files):
            write(at / f"in/{k}.json", "\n".join(lines))
            os.utime(at / f"in/{k}.json", (k + 1, k + 1))
        e = incremental.replay_edges(spark, str(at / "in"), known, str(at / "out"), str(at / "cp"), "json", 1)
        assert sorted((r.source, r.target, r.snp_distance) for r in e.collect()) == want


def test_entry_without_optional_package(spark, data, tmp_path):
    import __spark_entry__ as entry

    have = set(entry.queries())
    assert set(entry.oracle_sql()) <= have
    assert entry.entry(spark).count() > 0
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for broken in (False, True):  # the package is gone, or cannot be imported
        at = tmp_path / str(broken)
        shutil.copytree(os.path.join(root, "strainweave"), at / "strainweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(root, "__spark_entry__.py"), at)
        if broken:
            (at / "strainweave/llm").mkdir()
            (at / "strainweave/llm/__init__.py").write_text("")
            (at / "strainweave/llm/queries.py").write_text("import no_such_module\n")
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(' '.join(e.queries()))"], cwd=at, env=os.environ | {"PYTHONPATH": str(at)}, capture_output=True, text=True, check=True)
        core = said.stdout.split()
        assert "p1_found" in core and not any(n.startswith(("p2_", "p3_", "p6_", "p7_", "p8_")) for n in core)
