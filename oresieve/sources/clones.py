"""Files of repositories that are cloned in tasks: one shallow clone at a time, removed when its files are read."""

from __future__ import annotations

import os
import re
import shutil
import stat
import subprocess
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import constants as K

#: Seconds that a clone may take; characters of an error that are kept; bytes of files in one batch of rows.
TIMEOUT, ERROR_CHARS, BATCH_BYTES = 300, 200, 8_000_000
ROWS = "full_name string, path string, status int, content string, clone_status string, error string"


def remove_tree(path: str) -> None:
    """Removes a folder, also one that holds files that may not be written; a missing one is no error."""

    def writable(function, name, _):
        os.chmod(name, stat.S_IWRITE)
        function(name)

    if os.path.exists(path):
        shutil.rmtree(path, onexc=writable)


def shallow_clone(url: str, folder: str, timeout: float = TIMEOUT) -> str | None:
    """Clones the last commit into a folder, which is emptied first and removed on failure. Returns None, or the error's first characters."""
    remove_tree(folder)
    error = None
    try:
        done = subprocess.run(["git", "clone", "--depth", "1", "--quiet", "--", url, folder], timeout=timeout, capture_output=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
        if done.returncode:
            error = done.stderr.decode(errors="ignore").strip()[:ERROR_CHARS] or f"exit {done.returncode}"
    except subprocess.TimeoutExpired:
        error = f"no end after {timeout:g} s"
    except OSError as e:
        error = str(e)[:ERROR_CHARS]
    if error is not None:
        remove_tree(folder)
    return error


def _files(folder: str, wanted: re.Pattern):
    for at, folders, names in os.walk(folder):
        folders[:] = sorted(d for d in folders if d not in K.VENDORED)
        for name in sorted(names):
            full = os.path.join(at, name)
            path = os.path.relpath(full, folder).replace(os.sep, "/")
            if wanted.search(path) and os.path.isfile(full) and not os.path.islink(full):
                with open(full, "rb") as file:
                    yield path, file.read().decode(errors="replace")


def cloned(repositories: DataFrame, work_folder: str, pattern: str = K.TEST_FILE, timeout: float = TIMEOUT) -> DataFrame:
    """The files of (full_name, clone_url) whose path matches, as ROWS; a repository that can't be cloned, or has none, is a row without a path.

    work_folder: a folder of the machine that runs a task, for the one clone that the task is at; nothing in it outlives the repository's
    rows, and no other task reads it, so that a lost executor loses only work. One repository's failure is its row's error.
    """
    wanted = re.compile(pattern)

    def run(batches):
        for batch in batches:
            for name, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = os.path.join(work_folder, f"clone-{uuid.uuid4().hex}")
                try:
                    error = "no clone_url" if not url else shallow_clone(url, folder, timeout)
                    rows, size = [], 0
                    for path, content in _files(folder, wanted) if error is None else ():
                        rows.append((name, path, 200, content, "ok", None))
                        size += len(content)
                        if size > BATCH_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows or [(name, None, None, None, "ok" if error is None else "failed", error)])
                finally:
                    remove_tree(folder)

    return repositories.select("full_name", "clone_url").mapInArrow(run, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
    names = ("full_name", "path", "status", "content", "clone_status", "error")
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
