"""What a run does to files: copies with embedded tags, moves without collisions, and lines behind those of earlier runs.

The first two take a planned table and act on storage that every executor mounts.  Each step can be repeated: one that runs
again finds what it did and leaves it.
"""

from __future__ import annotations

import os
import shutil
import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOVED = "original_name string, destination string, final_name string, done string"


def find_tool(name: str, beside: str | None = None) -> str | None:
    """The tool in a folder, else on the path."""
    for ending in ("", ".exe"):
        if beside and os.access(path := os.path.join(beside, name + ending), os.X_OK):
            return path
    return shutil.which(name)


def works(tool: str | None) -> bool:
    """Whether the tool answers with its version."""
    try:
        return tool is not None and subprocess.run([tool, "-ver"], capture_output=True, check=False).returncode == 0
    except OSError:
        return False


def ensure_dirs(folder: str, names: list[str]) -> None:
    for name in names:
        os.makedirs(os.path.join(folder, name), exist_ok=True)


def move(source: str, target: str) -> str:
    """moved, or there already; another file of the target's name is never replaced."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    if not os.path.exists(source):
        return "there already" if os.path.exists(target) else "missing"
    try:
        os.link(source, target)  # fails where the name is taken, unlike a rename
    except FileExistsError:
        if not os.path.samefile(source, target):
            return "name taken"
    except OSError:  # storage without links
        if os.path.exists(target):
            return "name taken"
        shutil.move(source, target)
        return "moved"
    os.unlink(source)
    return "moved"


def apply_moves(plan: DataFrame, folder: str) -> DataFrame:
    """MOVED: the plan (original_name, destination, final_name) carried out.  Write the result: it acts when it is evaluated."""

    def run(it):
        for batch in it:
            names = [batch.column(c).to_pylist() for c in ("original_name", "destination", "final_name")]
            done = [move(os.path.join(folder, a), os.path.join(folder, b, c)) for a, b, c in zip(*names, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (*names, done)], ["original_name", "destination", "final_name", "done"])

    return plan.select("original_name", "destination", "final_name").mapInArrow(run, MOVED)


def apply_files(plan: DataFrame, folder: str) -> DataFrame:
    """ord, seq, done: the effects of sinks.file_effects carried out, each record's in order.  Write the result: it acts when it is evaluated."""

    def run(it):
        for batch in it:
            ords, seqs, done, failed = batch.column("ord").to_pylist(), batch.column("seq").to_pylist(), [], set()
            for number, kind, source, target in zip(ords, *(batch.column(c).to_pylist() for c in ("kind", "source", "target")), strict=True):
                a, b = os.path.join(folder, source), os.path.join(folder, target)
                if number in failed:
                    done.append("left")
                elif kind == "move":
                    done.append(move(a, b))
                else:  # the copy of it is in place
                    if os.path.exists(a) and os.path.exists(b):
                        os.unlink(a)
                    done.append("dropped")
                if done[-1] == "name taken":
                    failed.add(number)
            yield pa.RecordBatch.from_arrays([pa.array(ords, pa.int32()), pa.array(seqs, pa.int32()), pa.array(done, pa.string())], ["ord", "seq", "done"])

    steps = plan.select("ord", "seq", "kind", "source", "target")
    # One list a record, so that its steps are in one batch.
    lists = steps.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "source", "target"))).alias("steps"))
    return lists.select("ord", F.inline("steps")).mapInArrow(run, "ord int, seq int, done string")


def stage_tags(plan: DataFrame, folder: str, tool: str) -> DataFrame:
    """name, tag_error: a copy of each file with its tags, where the tool's trouble is that item's error and ends nothing else.

    plan: name, source, copy (paths below the folder), tags (array of tag, value).  A copy is made anew, from the file as it was,
    under another name, and takes its own when it is whole; so a task that runs again adds no tag twice.
    """

    def one(source: str, copy: str, tags: list[dict]) -> str | None:
        draft = f"{copy}.{os.getpid()}"
        try:
            shutil.copyfile(source, draft)
            embed(tool, draft, [(t["tag"], t["value"]) for t in tags])
            os.replace(draft, copy)
        except (OSError, RuntimeError) as e:
            return str(e) or type(e).__name__
        finally:
            if os.path.exists(draft):
                os.unlink(draft)
        return None

    def run(it):
        for batch in it:
            columns = [batch.column(c).to_pylist() for c in ("source", "copy", "tags")]
            errors = [one(os.path.join(folder, a), os.path.join(folder, b), t) for a, b, t in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(errors, pa.string())], ["name", "tag_error"])

    return plan.select("name", "source", "copy", "tags").mapInArrow(run, "name string, tag_error string")


def size_of(path: str) -> int:
    return os.path.getsize(path) if os.path.exists(path) else 0


def append(path: str, at: int, head: bytes, lines: bytes) -> None:
    """Put lines behind the first `at` bytes of a file (and the head before them where the file is new), once.

    at: the file's size when the lines were planned.  A write that was cut off is taken back and done again; where the file has
    since been changed by others, the lines go to its end, unless they are there.
    """
    data = (head if at == 0 else b"") + lines
    with open(path, "ab+") as f:
        f.seek(min(at, os.path.getsize(path)))
        rest = f.read()
        if len(rest) >= len(data) and data in rest:
            return
        if rest and data.startswith(rest):
            f.truncate(at)
        elif rest or os.path.getsize(path) < at:
            data = (head if os.path.getsize(path) == 0 else b"") + lines
        f.seek(0, os.SEEK_END)
        f.write(data)
        f.flush()
        os.fsync(f.fileno())


def tag_command(tool: str, file: str, tags: list[tuple[str, str]]) -> list[str]:
    """The tool's arguments: keywords are added one by one, other tags are set."""
    listed = ("Keywords", "XMP-dc:Subject")
    return [tool, "-overwrite_original", *(f"-{t}{'+=' if t in listed else '='}{v or ''}" for t, v in tags), file]


def embed(tool: str, file: str, tags: list[tuple[str, str]]) -> None:
    result = subprocess.run(tag_command(tool, file, tags), capture_output=True, text=True, check=False)
    if result.returncode:
        raise RuntimeError(f"tags were not written: {result.stderr.strip()}")
