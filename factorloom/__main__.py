"""spark-submit entry: factorise a matrix file and write the result.

    python -m factorloom INPUT OUTPUT --patterns 3 [--iterations 1000 --seed 42 --sparse
        --distributed genome-wide --sets 4 --transpose --normalize --checkpoint DIR --every 500]
"""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="factorloom")
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--patterns", type=int, required=True)
    parser.add_argument("--iterations", type=int, default=50_000)
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--sparse", action="store_true")
    parser.add_argument("--distributed", choices=["none", "genome-wide", "single-cell"], default="none")
    parser.add_argument("--sets", type=int, default=4)
    parser.add_argument("--transpose", action="store_true")
    parser.add_argument("--normalize", action="store_true", help="log-normalise counts by column first")
    parser.add_argument("--checkpoint")
    parser.add_argument("--every", type=int, default=0)
    o = parser.parse_args(args)

    from pyspark.sql import SparkSession

    from .model import Params
    from .operators import factorize, matrix
    from .sources import matrix_files

    spark = SparkSession.builder.appName("factorloom").getOrCreate()
    if matrix_files.supported(o.input):
        cells, dims, shape = matrix_files.read_matrix(spark, o.input)
    else:  # a directory of counts
        cells, dims, shape = matrix_files.read_10x(spark, o.input)
    if o.normalize:
        cells = matrix.log_normalize(cells)
    params = Params(o.patterns, n_iterations=o.iterations, seed=o.seed, sparse=o.sparse, distributed=o.distributed, n_sets=o.sets, checkpoint_path=o.checkpoint, checkpoint_interval=o.every)
    result = factorize.factorize(cells, params, transpose=o.transpose, dims=dims, shape=shape)
    matrix_files.write_parquet(result, o.output)
    print(result)


if __name__ == "__main__":
    main()
