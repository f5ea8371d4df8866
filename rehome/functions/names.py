"""Names, ids and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that a stored column name loses, and those that become "_".
REMOVED_CHARS = "(),;{}\n\t"
UNDERSCORE_CHARS = " ."

# Fixed value: longest name a store accepts.
MAX_NAME = 256

LITERAL, LIKE = "literal", "like"


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_suffix(c: Column | str, suffix: str, match: str = LITERAL) -> Column:
    """True where a name carries the suffix.

    ``literal`` compares text and is pushed to the scan. ``like`` reads the suffix as a LIKE
    pattern, in which ``_`` stands for any character.
    """
    if match == LIKE:
        return _as_col(c).like("%" + suffix)
    return _as_col(c).endswith(suffix)


def strip_suffix(c: Column | str, suffix: str, match: str = LITERAL) -> Column:
    """The name without its suffix: once at the end, or everywhere with ``match="like"``."""
    c = _as_col(c)
    if match == LIKE:
        return F.replace(c, F.lit(suffix), F.lit(""))
    cut = F.left(c, F.length(c) - F.lit(len(suffix)))
    return F.when(c.endswith(suffix), cut).otherwise(c)


def add_suffix(c: Column | str, suffix: str) -> Column:
    return F.concat(_as_col(c), F.lit(suffix))


def compose_name(*parts: Column | str, max_length: int = MAX_NAME) -> Column:
    """Parts joined by ``_`` and cut once, so that every use of the name agrees."""
    return F.left(F.concat_ws("_", *parts), F.lit(max_length))


def is_guid(c: Column | str) -> Column:
    """32 hexadecimal digits, with or without hyphens, braces or a ``urn:uuid:`` prefix."""
    bare = F.replace(F.replace(_as_col(c), F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    bare = F.replace(F.btrim(bare, F.lit("{}")), F.lit("-"), F.lit(""))
    return F.coalesce(bare.rlike(r"\A[0-9a-fA-F]{32}\z"), F.lit(False))


def move_path(
    path: Column | str,
    old_ws: Column | str,
    new_ws: Column | str,
    old_item: Column | str,
    new_item: Column | str,
    *,
    scheme: str = "abfss://",
    by: str = "id",
    store_ending: str = ".Lakehouse",
    suffix: str = "",
) -> Column:
    """Source path rewritten to the target workspace and store.

    By id the item id is exchanged and no suffix is added; by name the store folder is
    exchanged and ``suffix`` goes to the end of the path.
    """
    moved = F.replace(
        _as_col(path),
        F.concat(F.lit(scheme), _as_col(old_ws)),
        F.concat(F.lit(scheme), _as_col(new_ws)),
    )
    if by == "id":
        return F.replace(moved, _as_col(old_item), _as_col(new_item))
    ending = F.lit(store_ending)
    moved = F.replace(moved, F.concat(_as_col(old_item), ending), F.concat(_as_col(new_item), ending))
    return F.concat(moved, F.lit(suffix))


def clean_name(name: str) -> str:
    """A column name that a table format accepts."""
    drop = {ord(c): None for c in REMOVED_CHARS}
    return name.translate(drop | {ord(c): "_" for c in UNDERSCORE_CHARS})


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Clean every column name; a later column whose name is taken gets a number."""
    taken: set[str] = set()
    names = []
    for raw in df.columns:
        name, n = clean_name(raw), 1
        while name.lower() in taken:
            n += 1
            name = f"{clean_name(raw)}_{n}"
        taken.add(name.lower())
        names.append(name)
    return df.toDF(*names)
