"""Exchange a finished copy for an old target so that one of them is whole, whatever fails.

A journal beside the target says how far an exchange has come. The old target is set aside by a
rename, the new one is moved in, and the old one is deleted last. A store that moves no folders has
them moved file by file, so every step may stop half way; each one can be repeated or undone from what the
journal and the folders say. Runs inside Spark tasks.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyarrow import fs

JOURNAL, BEFORE = "__journal", "__before"
# How far an exchange may come. A whole target: the old one goes aside, the new one is placed; undone by
# clearing what was placed and going back. A merge: files are exchanged one by one, or put back.
PHASES = ("aside", "placing", "clear", "back", "merge", "unmerge")


def files_below(system, path: str) -> dict[str, int]:
    """Sizes of the files at or below a path, by what follows the path in their names."""
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return {"": info.size}
    if info.type != fs.FileType.Directory:
        return {}
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    root = len(info.path.rstrip("/"))
    return {x.path[root:]: x.size for x in found if x.type == fs.FileType.File}


def discard(system, path: str) -> None:
    info = system.get_file_info(path)
    if info.type == fs.FileType.Directory:
        system.delete_dir(path)
    elif info.type == fs.FileType.File:
        system.delete_file(path)


def exists(system, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


def holds(system, path: str, files: int, size: int) -> bool:
    found = files_below(system, path)
    return exists(system, path) and (len(found), sum(found.values())) == (files, size)


def _parent(system, path: str) -> None:
    system.create_dir(path.rsplit("/", 1)[0] or "/", recursive=True)


def move_into(system, source: str, place: str) -> None:
    """All that is at ``source`` to ``place``: at once, or file by file where something is there already
    or the store moves no folders. What has been moved by an earlier attempt stays."""
    if not exists(system, source):
        return
    _parent(system, place)
    if not exists(system, place):
        try:
            return system.move(source, place)
        except (NotImplementedError, pa.ArrowException, OSError):
            if system.get_file_info(source).type != fs.FileType.Directory:
                raise
    for name in files_below(system, source):
        _parent(system, place + name)
        system.move(source + name, place + name)
    if not files_below(system, source):
        if not exists(system, place):
            system.create_dir(place, recursive=True)
        discard(system, source)


def _note(system, place: str, phase: str, entry: dict) -> None:
    path = f"{place}{JOURNAL}.{phase}"
    if exists(system, path):
        return
    partial = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(partial) as out:
        out.write(json.dumps(entry).encode())
    system.move(partial, path)


def _noted(system, place: str) -> tuple[str | None, dict]:
    for phase in reversed(PHASES):
        path = f"{place}{JOURNAL}.{phase}"
        if exists(system, path):
            with system.open_input_stream(path) as stream:
                return phase, json.loads(stream.read())
    return None, {}


def _forget(system, place: str) -> None:
    """The furthest phase goes last: what is left after a failure still says how far it came."""
    for phase in PHASES:
        discard(system, f"{place}{JOURNAL}.{phase}")


def _finish(system, place: str, entry: dict) -> None:
    discard(system, entry["before"])
    discard(system, entry["staging"])
    _forget(system, place)


def _go_back(system, place: str, phase: str, entry: dict) -> None:
    """The old target as it was; each part may be repeated."""
    before = entry["before"]
    if phase in ("merge", "unmerge"):
        _note(system, place, "unmerge", entry)
        for name in entry["added"]:
            discard(system, place + name)
        for name in files_below(system, before):
            discard(system, place + name)
            _parent(system, place + name)
            system.move(before + name, place + name)
    else:
        if phase in ("placing", "clear"):
            _note(system, place, "clear", entry)
            discard(system, place)
            _note(system, place, "back", entry)
        move_into(system, before, place)
    _finish(system, place, entry)


def recover(system, place: str) -> str | None:
    """End an exchange that was cut short: ``old`` or ``new``, whichever the target is now; None without one.

    A new target that is all there is completed, anything else is undone.
    """
    phase, entry = _noted(system, place)
    if phase is None:
        return None
    before, staging, wanted = entry["before"], entry["staging"], (entry["files"], entry["bytes"])
    if phase == "placing":
        here, left = files_below(system, place), files_below(system, staging)
        if not holds(system, place, *wanted) and (exists(system, staging) or here) and (
                len(here) + len(left), sum(here.values()) + sum(left.values())) == wanted:
            move_into(system, staging, place)
        if holds(system, place, *wanted):
            _finish(system, place, entry)
            return "new"
    if phase == "merge" and not files_below(system, staging) and holds(system, place, *wanted):
        _finish(system, place, entry)
        return "new"
    _go_back(system, place, phase, entry)
    return "old"


def put_in_place(system, staging: str, place: str, run: str, files: int, size: int, removed: list[str] | None = None) -> str | None:
    """Let the staged copy take the place of the target: None, or what went wrong.

    ``files`` and ``size`` are those of the whole new target. With ``removed`` the staged files are merged
    into the target, and the files of these names leave it. Safe to repeat after a lost task.
    """
    ended = recover(system, place)
    if not exists(system, staging):
        if holds(system, place, files, size) and (ended != "old") and not removed:
            return None
        if removed is None:
            return "the staged copy is gone; the old target is in its place"
    entry = {"run": run, "staging": staging, "before": f"{place}{BEFORE}_{run}", "files": files, "bytes": size}
    if removed is None:
        return _replace(system, staging, place, entry)
    return _merge(system, staging, place, entry, removed)


def _undone(system, place: str, problem: str) -> str:
    phase, entry = _noted(system, place)
    try:
        if phase is not None:
            _go_back(system, place, phase, entry)
    except (OSError, ValueError, NotImplementedError, pa.ArrowException) as error:
        return f"{problem}; then, going back: {error}; the old target is at {entry["before"]}, and the next run ends the exchange"
    return problem


def _replace(system, staging: str, place: str, entry: dict) -> str | None:
    if not holds(system, staging, entry["files"], entry["bytes"]):
        discard(system, staging)
        return "the staged copy is not what was copied"
    placed = False
    try:
        if exists(system, place):
            _note(system, place, "aside", entry)
            move_into(system, place, entry["before"])
        _note(system, place, "placing", entry)
        move_into(system, staging, place)
        placed = holds(system, place, entry["files"], entry["bytes"])
        if not placed:
            return _undone(system, place, "the target is not what was copied")
        _finish(system, place, entry)
    except (OSError, ValueError, NotImplementedError, pa.ArrowException) as error:
        # What is left of a finished exchange is cleared away by the next one.
        return None if placed else _undone(system, place, str(error))
    return None


def _merge(system, staging: str, place: str, entry: dict, removed: list[str]) -> str | None:
    old, new, before = files_below(system, place), files_below(system, staging), entry["before"]
    entry["added"] = [name for name in new if name not in old]
    merged = False
    try:
        _note(system, place, "merge", entry)
        for name in [*new, *removed]:
            if name in old:
                _parent(system, before + name)
                system.move(place + name, before + name)
            if name in new:
                _parent(system, place + name)
                system.move(staging + name, place + name)
        merged = holds(system, place, entry["files"], entry["bytes"])
        if not merged:
            return _undone(system, place, "the target is not what was copied")
        _finish(system, place, entry)
    except (OSError, ValueError, NotImplementedError, pa.ArrowException) as error:
        return None if merged else _undone(system, place, str(error))
    return None
