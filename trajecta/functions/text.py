"""Column functions of names, keys and nested values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_scene(name: Column) -> Column:
    """F30."""
    return F.replace(name, F.lit("/"), F.lit("_"))


def pascal(name: Column, suffix: str = "") -> Column:
    """snake_case to PascalCase; the tail of each word is lower-cased."""
    words = F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20))))
    return F.concat(F.array_join(words, ""), F.lit(suffix))


def scene_keyword(name: Column) -> Column:
    """F32: drop a leading date and a trailing number of one or two digits."""
    return F.regexp_replace(F.regexp_replace(name, r"^\d{4}-\d{2}-\d{2}-", ""), r"-\d{1,2}$", "")


def frame_key(index: Column, digits: int = 6, fixed: bool = False) -> Column:
    """zero-padded frame number. Longer numbers stay whole; where `fixed`, they are cut to their first digits, as lpad of SQL does."""
    return F.lpad(index.cast("string"), digits, "0") if fixed else F.format_string(f"%0{digits}d", index)


def threshold_text(x: Column) -> Column:
    """four decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.4f", x), r"\.?0+$", "")


def file_name(label: Column) -> Column:
    """only letters, digits, dot, dash and underscore."""
    return F.regexp_replace(label, r"[^A-Za-z0-9._-]+", "_")


def csv_field(value: Column) -> Column:
    """Quoted where a comma, a quote or a line end asks for it; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n\r]'), quoted).otherwise(text)


def label_of(key: Column) -> Column:
    """a key as a heading."""
    return F.initcap(F.regexp_replace(key, "[_.]+", " "))


def flatten_struct(df, column: str, sep: str = ".") -> list[Column]:
    """leaves of a struct column as columns with dotted names."""
    out: list[Column] = []

    def walk(path: list[str], kind) -> None:
        for field in kind.fields:
            here = [*path, field.name]
            if field.dataType.typeName() == "struct":
                walk(here, field.dataType)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in [column, *here])).alias(sep.join(here)))

    walk([], df.schema[column].dataType)
    return out


def deep_merge(base: dict[str, Any], override: dict[str, Any]) -> dict[str, Any]:
    """mappings merge key by key, anything else is replaced."""
    out = dict(base)
    for k, v in override.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def merge_maps(base: Column, override: Column) -> Column:
    """F36 for one level of map columns: the override wins."""
    return F.map_zip_with(base, override, lambda _, a, b: F.coalesce(b, a))


def public_keys(m: Column) -> Column:
    """drop keys that begin with an underscore."""
    return F.map_filter(m, lambda k, _: ~k.startswith("_"))


def camera_of(scene: Column, table: dict[str, str], default: str) -> Column:
    """the first camera whose mark the scene name contains."""
    out = F.lit(default)
    for mark, camera in reversed(list(table.items())):
        out = F.when(scene.contains(mark), F.lit(camera)).otherwise(out)
    return out


def int_parameter(url: Column, name: str, low: int, high: int) -> Column:
    """an integer of a query string, null where it is missing, no number or out of range."""
    raw = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    value = F.try_cast(F.nullif(raw, F.lit("")), "int") if hasattr(F, "try_cast") else F.nullif(raw, F.lit("")).try_cast("int")
    return F.when(value.between(low, high), value)


def jsonable(x: Column) -> Column:
    """Non-finite numbers become null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def rows_of_lists(df, id_cols: list[str], lists: list[str]):
    """Parallel arrays to one row an element, with its position."""
    zipped = df.select(*id_cols, F.posexplode(F.arrays_zip(*lists)).alias("pos", "_row"))
    return zipped.select(*id_cols, "pos", *[F.col("_row")[c].alias(c) for c in lists])
