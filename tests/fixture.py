"""A small outbreak as the files that the readers take."""

import os
import random
from datetime import date, timedelta


def write_fixture(folder, n=28, groups=4, seed=5):
    """A square matrix, metadata, profiles and the truth; isolate i belongs to group i % groups."""
    rng = random.Random(seed)
    os.makedirs(folder, exist_ok=True)
    ids = [f"S{i:03d}" for i in range(n)]
    d = [[0] * n for _ in ids]
    for i in range(n):
        for j in range(i):
            d[i][j] = d[j][i] = rng.randint(1, 9) if i % groups == j % groups else rng.randint(60, 120)
    files = {
        "snp_matrix.tsv": "\t".join(["", *ids]) + "\n" + "".join("\t".join([x, *map(str, row)]) + "\n" for x, row in zip(ids, d)),
        "epi.csv": "isolate_id,collection_date,facility,ward\n" + "".join(f"{x},{date(2023, 3, 1) + timedelta(60 * (i % groups) + rng.randrange(18))},F{i % 3},W{i % groups}\n" for i, x in enumerate(ids)),
        "mlst.csv": "isolate_id,ST\n" + "".join(f"{x},ST{100 + i % groups}\n" for i, x in enumerate(ids)),
        "truth.csv": "isolate_id,true_cluster\n" + "".join(f"{x},{i % groups}\n" for i, x in enumerate(ids)),
    }
    paths = {k: os.path.join(folder, k) for k in files}
    for k, text in files.items():
        with open(paths[k], "w") as f:
            f.write(text)
    return paths
