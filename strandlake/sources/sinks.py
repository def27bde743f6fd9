"""Results as FASTA, JSON, Markdown and plain text.

Tables are written by Spark; the reports are a few rows by contract and are put together on the
driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.genetic_code import NUTRITION_SOURCES, nutrition_of

PROTEIN_WIDTH = 60
DNA_WIDTH = 70


def fasta_text(records: DataFrame, width: int | None = DNA_WIDTH, header: str = "header", column: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, value): each record as one text, wrapped to ``width`` or not at all."""
    body = F.col(column) if width is None else S.wrapped(F.col(column), width)
    return records.select(*keep, F.concat(F.lit(">"), F.col(header), F.lit("\n"), body).alias("value"))


def write_fasta(records: DataFrame, path: str, width: int | None = DNA_WIDTH, header: str = "header", column: str = "seq", order: str | None = None) -> None:
    """A folder of FASTA files; with ``order`` they are sorted across files by range."""
    if order is not None:
        records = records.orderBy(order)
    fasta_text(records, width, header, column).write.mode("overwrite").text(path)


def write_reads(reads: DataFrame, path: str) -> None:
    """Reads as >read_1, >read_2 and so on, unwrapped."""
    named = reads.select("read_id", F.concat(F.lit("read_"), F.col("read_id") + 1).alias("header"), "seq")
    write_fasta(named, path, None, order="read_id")


def nutrition_json(first: list[str], second: list[str], names: tuple[str, str] = ("sars_cov_2", "influenza")) -> str:
    """The report on two lists of amino acids, first list first."""
    every = list(dict.fromkeys([*first, *second]))
    details = {aa: {k: nutrition_of(aa)[k] for k in ("name", "low_foods", "rich_foods")} for aa in every}
    return json.dumps({"sources": NUTRITION_SOURCES, "top_amino_acids": dict(zip(names, (first, second))), "amino_acids": details}, indent=2)


def nutrition_markdown(first: list[str], second: list[str], titles: tuple[str, str] = ("SARS-CoV-2", "Influenza")) -> str:
    # fixed values: the headings and labels
    def named(aas: list[str]) -> str:
        return ", ".join(f"{aa} ({nutrition_of(aa)['name']})" for aa in aas)

    blocks = ["# Amino-acid Nutrition Summary\n"]
    blocks += [f"**Top-3 ({title}):** {named(aas)}" for title, aas in zip(titles, (first, second))]
    blocks.append("\n## Foods guidance (examples)\n")
    for aa in dict.fromkeys([*first, *second]):
        known = nutrition_of(aa)
        low = known.get("low_foods_in_summary", known["low_foods"])
        blocks += [f"### {aa} — {known['name']}", f"- Low in: {', '.join(low)}", f"- Rich in: {', '.join(known['rich_foods'])}\n"]
    return "\n".join([*blocks, f"**Sources:** {'; '.join(NUTRITION_SOURCES)}\n"])


#: The lines of the report.
ASSEMBLY_REPORT = """\
=== Assembly Report (Exercise 1) ===
Reference length: {ref_len}
Reads: {reads} (len {min_len}–{max_len})
Greedy min-overlap k: {k}
Assembled contig length: {contig_len}
Reference ⊂ Contig? {ref_in_contig}
Contig ⊂ Reference? {contig_in_ref}
Best shift (ref vs contig): {shift}
Crude identity at best shift: {identity:.4f}
"""


def assembly_report(row: dict) -> str:
    """The text report of one assembly (see ``plans.assembly``)."""
    yes = {k: "YES" if row[k] else "NO" for k in ("ref_in_contig", "contig_in_ref")}
    return ASSEMBLY_REPORT.format(**{**row, **yes})


LIMITATIONS = """\
What greedy assembly of short reads cannot settle

- A repeat that is longer than the overlap looks the same wherever it stands: its copies are
  merged, or the wrong ones are joined.
- Runs of one symbol and other simple stretches overlap in many ways at once.
- Near copies force a choice between paths; a longer overlap avoids false joins and loses true
  ones.
- Where no read spans a gap, the contig ends.
- Reads here have one direction and no errors; real ones have both directions and errors.
"""


def chart_image(layers: DataFrame, path: str, title: str) -> None:
    """A PNG of the layers of one chart (see ``windows.chart_layers``), where matplotlib is there. It
    only draws what the table says; charts are few points by contract."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError as error:
        raise RuntimeError("charts need matplotlib; the layers are in the DataFrame") from error
    found: dict[tuple, list] = {}
    for row in layers.select("layer", "series", "x", "y", "colour").orderBy("layer", "series", "x").collect():
        found.setdefault((row.layer, row.series, row.colour), []).append((row.x, row.y))
    figure, axes = pyplot.subplots(figsize=(12, 4.2))
    for (layer, series, colour), points in found.items():
        if layer == "limit":
            axes.set_ylim(**{"bottom" if series == "low" else "top": points[0][1]})
        elif layer == "grid":
            axes.axhline(points[0][1], color="0.85", linewidth=0.8)
        else:
            axes.plot([p[0] for p in points], [p[1] for p in points], color=f"C{colour}", label=series)
    axes.set_title(title)
    figure.savefig(path, dpi=100)
    pyplot.close(figure)
