"""Command line: `python -m colophon FOLDER --provider module:factory`, one batch at a time."""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from .config import Settings
from .sources import effects


def prerequisites(folder: str, provider: str | None, key: str | None, tool: str | None, need_tool: bool) -> str | None:
    """What is missing for a run, the first thing only; the folders are made on the way."""
    from .plans.run import FOLDERS

    if not os.path.isdir(folder):
        return f"no such folder: {folder}"
    effects.ensure_dirs(folder, FOLDERS)
    if need_tool and not effects.works(tool):
        return "the tag tool does not answer; put it beside this program or on the path, or leave --tag-tool out"
    if not provider:
        return "no provider; name one as module:factory"
    return None if key is None or os.environ.get(key) else f"the provider's key is not set: {key}"


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="colophon", description="Process one batch of a folder of pictures.")
    parser.add_argument("folder")
    parser.add_argument("--provider", help="module:factory, called in the task to build the provider")
    parser.add_argument("--key", help="environment variable that the provider needs")
    parser.add_argument("--tag-tool", help="program that embeds tags")
    parser.add_argument("--limit", type=int, default=Settings.batch_limit)
    parser.add_argument("--pause", type=float, default=Settings.pause_seconds)
    parser.add_argument("--model", default=Settings.model)
    given = parser.parse_args(args)
    folder = os.path.abspath(os.path.expanduser(given.folder))
    tool = effects.find_tool(given.tag_tool, os.path.dirname(os.path.abspath(sys.argv[0]))) if given.tag_tool else None
    if missing := prerequisites(folder, given.provider, given.key, tool, bool(given.tag_tool)):
        print(missing, file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from .operators.report import console
    from .plans.run import run

    module, _, factory = given.provider.partition(":")
    make = getattr(importlib.import_module(module), factory or "make")
    spark = SparkSession.builder.appName("colophon").getOrCreate()
    done = run(spark, folder, make, Settings(batch_limit=given.limit, pause_seconds=given.pause, model=given.model), tool)
    print(console(done) if done else "Nothing is pending.")
    return 0


if __name__ == "__main__":
    sys.exit(main())
