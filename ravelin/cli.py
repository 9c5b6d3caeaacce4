"""Command line: the review, itemset, similarity and rating programs over files.

    python -m ravelin.cli summary reviews.json out.json
    python -m ravelin.cli partitions reviews.json out.json 8
    python -m ravelin.cli cities reviews.json businesses.json out_csv out.json
    python -m ravelin.cli itemsets pairs.csv out.txt --case 1 --support 4
    python -m ravelin.cli itemsets pairs.csv out.txt --larger-than 70 --support 50
    python -m ravelin.cli similar pairs.csv out_csv
    python -m ravelin.cli predict train.csv test.csv out_csv --case 2
"""

from __future__ import annotations

import argparse
import json
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import explore, itemsets, layout, recommend, similarity
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ravelin", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in paths:
            c.add_argument(x)
        return c

    command("summary", "reviews", "output").add_argument("--year", default="2018")
    command("partitions", "reviews", "output").add_argument("partitions", type=int)
    command("cities", "reviews", "businesses", "csv", "output").add_argument("--order-by-exact", action="store_true")
    c = command("itemsets", "pairs", "output")
    c.add_argument("--case", type=int, choices=[1, 2], default=1)
    c.add_argument("--support", type=int, required=True)
    c.add_argument("--larger-than", type=int)
    command("similar", "pairs", "output").add_argument("--threshold", type=float, default=0.5)
    command("predict", "train", "test", "output").add_argument("--case", type=int, choices=[1, 2, 3, 4], required=True)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"ravelin {a.command}").getOrCreate()
    if a.command == "summary":
        files.write_document(explore.report(files.reviews(spark, a.reviews), a.year), a.output)
    elif a.command == "partitions":
        counts = explore.counts(files.review_businesses(spark, a.reviews), "business_id")
        Path(a.output).write_text(json.dumps(layout.compare_partitioners(counts, a.partitions)))
    elif a.command == "cities":
        found = explore.city_stars(files.businesses(spark, a.businesses), files.review_stars(spark, a.reviews), a.order_by_exact).persist()
        files.write_city_stars(found, a.csv)
        found.show(10, truncate=False)
        Path(a.output).write_text(json.dumps(layout.compare_fetches(found)))
        found.unpersist()
    elif a.command == "itemsets":
        began = time.time()
        rows = itemsets.baskets(files.pairs(spark, a.pairs), a.case, a.larger_than)
        files.write_itemset_report(*itemsets.levels(rows, a.support), a.output)
        print(f"Duration: {time.time() - began:.1f}")
    elif a.command == "similar":
        files.write_similar(similarity.similar(files.pairs(spark, a.pairs), a.threshold), a.output)
    else:
        load = lambda path: files.ratings(spark, path).withColumnRenamed("business_id", "item_id")
        found = recommend.predict(a.case, load(a.train), load(a.test)).persist()
        files.write_predictions(found.withColumnRenamed("item_id", "business_id"), a.output)
        print("RMSE:", recommend.rmse(found).first().rmse)
        found.unpersist()


if __name__ == "__main__":
    main()
