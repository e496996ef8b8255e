"""Trajectories as tables: a row for each atom of each frame, from PDB text or from Parquet blocks.

A scan names the frames (first, last, stride) and the atoms it wants. Text is split at the ends of
frames by Spark's reader, so a file of any length is read by many tasks, and a frame that is not asked
for is dropped before its lines are taken apart. Parquet lies in blocks of frames: a range of frames
reads its blocks only, and atoms are filtered in the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The atom names of the selections, and the residues of a protein.
ALPHA = ["CA"]
BACKBONE = ["N", "CA", "C", "O"]
MINIMAL = ["N", "CA", "CB", "C", "O"]
RESIDUES = ["ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL"]

# The atom that stands for a residue's side chain.
SIDE_CHAIN = {"ALA": "CA", "ARG": "CZ", "ASN": "CG", "ASP": "CG", "CYS": "CB", "GLN": "CD", "GLU": "CD", "GLY": "CA", "HSD": "CE1", "HSE": "CE1", "HSP": "CE1", "ILE": "CG1", "LEU": "CD1", "LYS": "CE", "MET": "SD", "PHE": "CE1", "PRO": "CD", "SER": "CB", "THR": "CB", "TRP": "CE3", "TYR": "CZ", "VAL": "CB"}

BLOCK = 1000


def selected(select: str | list[str] | None) -> Column:
    """Whether an atom (columns name, residue) is in a selection: alpha, backbone, minimal, heavy, protein, a list of names, or all for none."""
    if select is None:
        return F.lit(True)
    if not isinstance(select, str):
        return F.col("name").isin(*select)
    if select not in ("alpha", "backbone", "minimal", "heavy", "protein"):
        raise ValueError(f"no selection is called {select}")
    names = {"alpha": ALPHA, "backbone": BACKBONE, "minimal": MINIMAL}
    return F.col("name").rlike("[CNO]") if select == "heavy" else F.col("residue").isin(RESIDUES) if select == "protein" else F.col("name").isin(names[select])


def side_chain_atoms(atoms: DataFrame) -> DataFrame:
    """(resid, serial): of each residue, the first atom that stands for its side chain; residues without one are left out."""
    known = F.create_map(*(F.lit(x) for pair in SIDE_CHAIN.items() for x in pair))
    found = atoms.select("resid", "residue", "name", "serial").distinct().where(F.col("name") == F.try_element_at(known, F.col("residue")))
    return found.groupBy("resid").agg(F.min("serial").alias("serial"))


def side_chain_pairs(atoms: DataFrame) -> DataFrame:
    """(a, b): the serials of all pairs of side-chain atoms, the lower residue first. A molecule's residues are few."""
    chosen = side_chain_atoms(atoms)
    a, b = chosen.select(F.col("resid").alias("ra"), F.col("serial").alias("a")), chosen.select(F.col("resid").alias("rb"), F.col("serial").alias("b"))
    return a.join(F.broadcast(b), F.col("ra") < F.col("rb")).select("a", "b")


def _asked(first: int | None, last: int | None, stride: int) -> Column:
    """Whether a frame is asked for: every ``stride``-th from ``first`` (from 0 on if none is given) up to ``last``."""
    if stride < 1:
        raise ValueError("stride must be 1 or more")
    frame = F.col("frame")
    wanted = frame >= first if first is not None else F.lit(True)
    wanted = wanted & (frame <= last) if last is not None else wanted
    return wanted & (F.pmod(frame - (first or 0), F.lit(stride)) == 0) if stride > 1 else wanted


def read_pdb(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, stride: int = 1, select: str | list[str] | None = None) -> DataFrame:
    """file, frame, serial, name, residue, resid, x, y, z and b of the atoms of PDB models; a model without a number, and lines that are no atoms, are left out."""
    models = spark.read.option("lineSep", "ENDMDL\n").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    models = models.withColumn("frame", F.regexp_extract("value", r"MODEL +(\d+)", 1).try_cast("long")).where(F.col("frame").isNotNull() & _asked(first, last, stride))
    lines = models.select("file", "frame", F.explode(F.split("value", "\n")).alias("line")).where(F.col("line").startswith("ATOM") | F.col("line").startswith("HETATM"))

    def cut(at: int, size: int) -> Column:
        return F.trim(F.substring("line", at, size))

    text = [(7, 5, "serial", "long"), (13, 4, "name", "string"), (18, 3, "residue", "string"), (23, 4, "resid", "int"), (31, 8, "x", "double"), (39, 8, "y", "double"), (47, 8, "z", "double"), (61, 6, "b", "double")]
    return lines.select("file", "frame", *(cut(at, size).try_cast(kind).alias(c) for at, size, c, kind in text)).where(selected(select))


def write_pdb(atoms: DataFrame, path: str) -> None:
    """Writes atoms (frame, serial, name, residue, resid, x, y, z, b) as PDB models, each by itself."""
    line = F.format_string("ATOM  %5d %-4s %3s A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f\n", "serial", "name", "residue", "resid", "x", "y", "z", F.lit(1.0), "b")
    models = atoms.withColumn("line", line).groupBy("frame").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("serial", "line"))), lambda x: x["line"]), "").alias("lines"))
    models.select(F.concat(F.format_string("MODEL %8d\n", "frame"), "lines")).write.option("lineSep", "ENDMDL\n").text(path)


def write_blocks(atoms: DataFrame, path: str, block: int = BLOCK) -> None:
    """Writes atoms as Parquet in blocks of ``block`` frames of a file, in the order of the frames."""
    placed = atoms.withColumn("block", F.floor(F.col("frame") / block))
    placed.repartition("file", "block").sortWithinPartitions("file", "block", "frame", "serial").write.partitionBy("block").parquet(path)


def scan_blocks(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, stride: int = 1, select: str | list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """The atoms of the frames asked for, of the blocks that hold such frames only."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("block") >= first // block)
    if last is not None:
        rows = rows.where(F.col("block") <= last // block)
    return rows.where(_asked(first, last, stride) & selected(select)).drop("block")
