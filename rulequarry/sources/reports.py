"""Small results as text: Markdown, LaTeX, run reports. Frames given here are aggregates of a few hundred rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from rulequarry.functions.text import duration
from rulequarry.operators.triples import mapping

#: Rows of a frame that a report shows at most.
SHOWN = 1000
_TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def _cells(df: DataFrame, order: Sequence[str]) -> list[list[str]]:
    rows = (df.orderBy(*order) if order else df).limit(SHOWN).collect()
    return [["" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r] for r in rows]


def markdown(df: DataFrame, order: Sequence[str] = ()) -> str:
    lines = [df.columns, ["---"] * len(df.columns), *[[c.replace("|", r"\|") for c in r] for r in _cells(df, order)]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def latex(df: DataFrame, caption: str, order: Sequence[str] = ()) -> str:
    """A longtable."""
    tex = lambda s: "".join(_TEX.get(c, c) for c in s)
    row = lambda cells: " & ".join(map(tex, cells)) + r" \\"
    return "\n".join([rf"\begin{{longtable}}{{{'l' * len(df.columns)}}}", rf"\caption{{{tex(caption)}}} \\", r"\hline", row(df.columns), r"\hline", *map(row, _cells(df, order)), r"\hline", r"\end{longtable}"])


def run_report(name: str, seconds: float, sections: Mapping[str, DataFrame]) -> str:
    return "\n\n".join([f"# {name}", f"Took {duration(seconds)}.", *[f"## {title}\n\n{markdown(df)}" for title, df in sections.items()]])


def check_mapping(manifest: Mapping, catalog, tsv: bytes | None = None) -> None:
    """Raises unless a stored mapping fits the catalog's schema, and the file's hash if one is stored."""
    if manifest.get("signature") != mapping(catalog)["signature"]:
        raise ValueError("the mapping belongs to another schema")
    if tsv is not None and manifest.get("tsv_sha256") != hashlib.sha256(tsv).hexdigest():
        raise ValueError("the mapping belongs to another export")


def dump_to_ansi(text: str) -> str:
    """A MySQL dump's tables and rows in standard SQL: quotes, escapes, types; keys, locks and settings go."""
    text = re.sub(r"/\*.*?\*/;?", "", text, flags=re.DOTALL)
    out = []
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith(("--", "#")) or re.match(r"(?i)(un)?lock tables|set |use |drop table|create database", bare):
            continue
        if re.match(r"(?i)(unique |fulltext |spatial )?key ", bare):
            continue
        if not re.match(r"(?i)insert ", bare):
            line = re.sub(r"(?i)\)\s*engine=.*;", ");", line)
            line = re.sub(r"(?i)\b(unsigned|zerofill|auto_increment)\b|character set \w+|collate \w+|comment '[^']*'|on update current_timestamp(\(\))?", "", line)
            line = re.sub(r"(?i)\b(tiny|small|medium|big)?int\(\d+\)", lambda m: (m[1] or "").replace("medium", "") + "int", line)
            line = re.sub(r"(?i)\b(tiny|medium|long)text\b|\benum\([^)]*\)|\bset\([^)]*\)", "text", line)
        line = line.replace("\\'", "''").replace('\\"', '"')
        out.append(line.replace("`", '"'))
    return re.sub(r",(\s*\n\s*\);)", r"\1", "\n".join(out))
