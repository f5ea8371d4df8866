"""The exchange of a target: whatever step fails, and however often, the old or the new one is whole."""

import itertools
import os

import pyarrow as pa
import pytest
from pyarrow import fs

from rehome.sinks.swap import BEFORE, JOURNAL, put_in_place, recover

OLD = {"a": "old a", "d/b": "old b", "gone": "x"}
NEW = {"a": "new a!", "d/b": "new b", "e/c": "new"}
CHANGES = {"a": "new a!", "e/c": "new"}  # what a merge brings; d/b stays, gone leaves
MERGED = {"a": "new a!", "d/b": "old b", "e/c": "new"}


class Failing:
    """A local store whose changes fail from the ``first`` to before the ``last``; it may refuse to move folders."""

    def __init__(self, first, last, folders):
        self.inner, self.n, self.first, self.last, self.folders = fs.LocalFileSystem(), 0, first, last, folders

    def _change(self):
        self.n += 1
        if self.first <= self.n < self.last:
            raise OSError(f"change {self.n} fails")

    def __getattr__(self, name):
        inner = getattr(self.inner, name)
        if name not in ("move", "delete_dir", "delete_file", "create_dir", "open_output_stream"):
            return inner

        def call(*args, **kwargs):
            if name == "move" and not self.folders and os.path.isdir(args[0]):
                raise pa.ArrowNotImplementedError("no folders here")
            if name == "delete_dir" and self.first <= self.n + 1 < self.last:  # half of it is gone
                for top, _, names in os.walk(args[0]):
                    for x in names[:1]:
                        os.remove(os.path.join(top, x))
            self._change()
            return inner(*args, **kwargs)

        return call


def fill(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, names in os.walk(root) for f in names}


def size(files):
    return len(files), sum(map(len, files.values()))


def exchange(system, root, merge):
    new = MERGED if merge else NEW
    return put_in_place(system, str(root / "t__in"), str(root / "t"), "r", *size(new), ["/gone"] if merge else None)


def steps(tmp_path, merge, folders, old):
    """The number of changes that an exchange makes when nothing fails."""
    root = tmp_path / "count"
    fill(root / "t__in", CHANGES if merge else NEW)
    if old:
        fill(root / "t", OLD)
    store = Failing(10**9, 10**9, folders)
    assert exchange(store, root, merge) is None
    assert tree(root) == {f"t/{k}": v for k, v in (MERGED if merge else NEW).items()}
    return store.n


@pytest.mark.parametrize("merge, folders, old", [(m, f, o) for m, f, o in itertools.product([False, True], [True, False], [True, False]) if o or not m])
@pytest.mark.parametrize("long", [1, 2, 3, 10**6])
def test_each_step_may_fail(tmp_path, merge, folders, old, long):
    new = MERGED if merge else NEW
    before = OLD if old else {}
    for step in range(1, steps(tmp_path, merge, folders, old) + 1):
        root = tmp_path / f"{step}"
        fill(root / "t__in", CHANGES if merge else NEW)
        if old:
            fill(root / "t", OLD)
        problem = exchange_error(Failing(step, step + long, folders), root, merge)
        here = tree(root / "t")
        if problem is None:
            assert here == new, step
        elif "the next run ends the exchange" not in problem:
            assert here == before, (step, problem)
        # The store is well again: the next run finds a whole target.
        recover(fs.LocalFileSystem(), str(root / "t"))
        told, here = here, tree(root / "t")
        assert here == new if problem is None else here in (before, new), (step, problem)
        assert told == here or "ends the exchange" in (problem or ""), (step, problem)
        assert not [x for x in os.listdir(root) if JOURNAL + "." in x and x.split(".")[-1] in ("aside", "placing", "clear", "back", "merge", "unmerge")]


def exchange_error(system, root, merge):
    try:
        return exchange(system, root, merge)
    except OSError as error:
        return str(error)


@pytest.mark.parametrize("merge, folders", list(itertools.product([False, True], [True, False])))
def test_a_task_that_is_lost_at_any_step_is_repeated(tmp_path, merge, folders):
    class Lost(BaseException):
        pass

    class Dying(Failing):
        def _change(self):
            self.n += 1
            if self.n == self.first:
                raise Lost

    for step in range(1, steps(tmp_path, merge, folders, True) + 1):
        root = tmp_path / f"{step}"
        fill(root / "t__in", CHANGES if merge else NEW)
        fill(root / "t", OLD)
        with pytest.raises(Lost):
            exchange(Dying(step, 0, folders), root, merge)
        problem = exchange(fs.LocalFileSystem(), root, merge)
        assert tree(root / "t") == (OLD if problem else MERGED if merge else NEW), (step, problem)
        assert not [x for x in os.listdir(root) if BEFORE in x], step


def test_a_copy_that_is_not_whole_is_not_placed(tmp_path):
    fill(tmp_path / "t__in", {"a": "1"})
    fill(tmp_path / "t", OLD)
    assert "not what was copied" in put_in_place(fs.LocalFileSystem(), str(tmp_path / "t__in"), str(tmp_path / "t"), "r", 2, 9)
    assert tree(tmp_path) == {f"t/{k}": v for k, v in OLD.items()}
    assert "is gone" in put_in_place(fs.LocalFileSystem(), str(tmp_path / "t__in"), str(tmp_path / "t"), "r", 2, 9)


def test_an_exchange_may_run_again(tmp_path):
    fill(tmp_path / "t__in", NEW)
    fill(tmp_path / "t", OLD)
    system = fs.LocalFileSystem()
    assert exchange(system, tmp_path, False) is None and exchange(system, tmp_path, False) is None
    fill(tmp_path / "t", {"b": "not of this run"})
    assert exchange(system, tmp_path, False) is not None
