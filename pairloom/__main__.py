"""Command line of the ingest jobs.

    spark-submit ... -m pairloom nested --out OUT de-en=FOLDER ru-en=FOLDER
    spark-submit ... -m pairloom aligned --out OUT --languages en-ko FOLDER
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pairloom.config import AlignedIngest, Ingest
from pairloom.functions.tokenizers import ByteTokenizer
from pairloom.plans import jobs


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="pairloom", description="Pack sentence pairs in token shards")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, defaults in (("nested", Ingest()), ("aligned", AlignedIngest())):
        command = commands.add_parser(name)
        command.add_argument("--out", required=True)
        command.add_argument("-s", "--shard-size", type=int, default=defaults.shard_size)
        command.add_argument("-n", "--max-pairs", type=int, default=defaults.max_pairs)
        command.add_argument("-m", "--max-seq-len", type=int, default=defaults.max_seq_len)
    commands.choices["nested"].add_argument("folders", nargs="+", metavar="PAIR=FOLDER")
    aligned = commands.choices["aligned"]
    aligned.add_argument("folder")
    aligned.add_argument("--languages", default="en-ko")
    aligned.add_argument("-b", "--batch-size", type=int, default=AlignedIngest().batch_size)
    aligned.add_argument("-f", "--fine-tune", action="store_true")
    return parser.parse_args()


def main() -> None:
    args = _arguments()
    spark = SparkSession.builder.appName(f"pairloom {args.command}").getOrCreate()
    tokenizer = ByteTokenizer()
    common = (args.shard_size, args.max_pairs, args.max_seq_len)
    if args.command == "nested":
        folders = dict(folder.split("=", 1) for folder in args.folders)
        jobs.ingest_nested(spark, folders, args.out, tokenizer, Ingest(*common))
    else:
        options = AlignedIngest(*common, args.batch_size, args.fine_tune)
        languages = tuple(args.languages.split("-"))
        jobs.ingest_aligned(spark, args.folder, languages, args.out, tokenizer, options)


if __name__ == "__main__":
    main()
