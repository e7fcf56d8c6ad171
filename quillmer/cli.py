"""Command line: ``python -m quillmer.cli COMMAND ...``.  Results are printed as text; collections are folders."""

from __future__ import annotations

import argparse
import shutil
import sys
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats
from .operators import compare, find, info, screen, sketch, taxonomy
from .params import SketchParams, parse_size
from .plans import shared_folder, written
from .sources import dumps, formats, sequences, store

VERSION = "0.2"
LICENSE = "quillmer stands on Apache Spark, Arrow, numpy and other libraries, which have licenses of their own."


def _options(p: argparse.ArgumentParser, memory_bound: bool = True) -> None:
    p.add_argument("-k", dest="kmer", type=int)
    p.add_argument("-s", dest="sketch_size", type=parse_size, default=1000)
    p.add_argument("-S", dest="seed", type=int, default=42)
    p.add_argument("-i", dest="individual", action="store_true", help="a sketch for each record")
    p.add_argument("-n", dest="noncanonical", action="store_true")
    p.add_argument("-a", dest="protein", action="store_true")
    p.add_argument("-z", dest="alphabet", help="letters of the sequences; implies -n")
    p.add_argument("-Z", dest="preserve_case", action="store_true")
    p.add_argument("-r", dest="reads", action="store_true")
    p.add_argument("-m", dest="min_copies", type=int, default=1)
    if memory_bound:
        p.add_argument("-b", dest="memory_bound")
    else:
        p.set_defaults(memory_bound=None)
    p.add_argument("-c", dest="target_coverage", type=float)
    p.add_argument("-g", dest="genome_size")
    p.add_argument("-M", dest="counts", action="store_true")
    p.add_argument("-w", dest="warning", type=float, default=0.01)
    p.add_argument("-l", dest="lists", action="store_true", help="inputs are files with a path a line")


def params_of(a: argparse.Namespace) -> SketchParams:
    given = {"sketch_size": a.sketch_size, "seed": a.seed, "concatenated": not a.individual, "preserve_case": a.preserve_case, "reads": a.reads, "min_copies": a.min_copies, "target_coverage": a.target_coverage, "genome_size": a.genome_size, "counts": a.counts, "warning": a.warning}
    if a.kmer:
        given["kmer"] = a.kmer
    if a.noncanonical:
        given["canonical"] = False
    if a.alphabet:
        if a.protein:
            raise ValueError("-a and -z exclude each other")
        given |= {"alphabet": a.alphabet, "canonical": False}
    return SketchParams.of(protein=a.protein, memory_bound=a.memory_bound, **given)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillmer")
    top.add_argument("--version", action="version", version=VERSION)
    top.add_argument("--license", action="version", version=LICENSE)
    commands = top.add_subparsers(dest="command", required=True)
    add = commands.add_parser
    p = add("sketch", help="sketch sequence files into a collection")
    _options(p)
    p.add_argument("-o", dest="output")
    p.add_argument("-I", dest="name")
    p.add_argument("-C", dest="comment")
    p.add_argument("inputs", nargs="+")
    for name in ("dist", "triangle", "within"):
        p = add(name)
        _options(p)
        p.add_argument("-C", dest="comments", action="store_true", help="comments in names")
        p.add_argument("-v", dest="max_p_value", type=float, default=1.0)
        p.add_argument("-d", dest="max_distance", type=float, default=1.0)
        p.add_argument("-e", dest="max_error", type=float, default=0.05)
        p.add_argument("-t", dest="table", action="store_true")
        p.add_argument("-E", dest="edges", action="store_true")
        p.add_argument("inputs", nargs="+", help="the first is the reference, but for triangle")
    for name in ("screen", "taxscreen"):
        p = add(name)
        p.add_argument("-w", "-W", dest="winner", action="store_true", help="winner takes all")
        p.add_argument("-i", dest="min_identity", type=float, default=0.0)
        p.add_argument("-v", dest="max_p_value", type=float, default=1.0)
        p.add_argument("-m", dest="mapping")
        p.add_argument("-t", dest="taxonomy", default=".")
        p.add_argument("collection")
        p.add_argument("inputs", nargs="+")
    p = add("find")
    _options(p, memory_bound=False)
    p.add_argument("-W", "-L", dest="window", type=parse_size, default=10_000)
    p.add_argument("-t", dest="threshold", type=float, default=0.0)
    p.add_argument("-b", "-B", dest="best", type=int, default=0)
    p.add_argument("-self", "--self", dest="exclude_self", action="store_true")
    p.add_argument("inputs", nargs=2)
    p = add("info")
    p.add_argument("-H", dest="header", action="store_true")
    p.add_argument("-t", dest="tabular", action="store_true")
    p.add_argument("-c", dest="histogram", action="store_true")
    p.add_argument("-d", dest="dump", action="store_true")
    p.add_argument("collection")
    p = add("paste")
    p.add_argument("-l", dest="lists", action="store_true", help="inputs are files with a path a line")
    p.add_argument("output")
    p.add_argument("inputs", nargs="+")
    for name, p in commands.choices.items():
        if name != "bounds":
            p.add_argument("-p", dest="cores", type=int, help="local cores, where no cluster is configured")
    p = add("bounds")
    p.add_argument("-k", dest="kmer", type=int, default=21)
    p.add_argument("-p", dest="probability", type=float, default=0.99)
    return top


def _stored(spark: SparkSession, path: str) -> str:
    """The path, or, for ``-``, that of a copy of the standard input below the shared folder."""
    if path != "-":
        return path
    name = f"{shared_folder(spark)}/stdin-{uuid.uuid4().hex}"
    at = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name.removeprefix("file:"))
    at[0].create_dir(at[1].rpartition("/")[0], recursive=True)
    with at[0].open_output_stream(at[1], compression=None) as out:
        shutil.copyfileobj(sys.stdin.buffer, out)
    return name


def _read(spark: SparkSession, inputs: list[str], params: SketchParams, lists: bool) -> DataFrame:
    """Sketches of collections and sequence files, in order."""
    paths = sequences.read_list(spark, *inputs) if lists else inputs
    parts, plain = [], []

    def flush() -> None:
        if plain:
            each = [[p] for p in plain] if params.reads else [list(plain)]
            parts.extend(sketch.sketch(sequences.read_sequences(spark, group), params) for group in each)
            plain.clear()

    for path in paths:
        if store.is_collection(path):
            flush()
            if found := store.load(spark, path, params):
                parts.append(found[0])
        else:
            plain.append(_stored(spark, path))
    flush()
    return written(store.union(parts), "inputs") if parts else spark.createDataFrame([], sketch.SKETCH_SCHEMA)


def _own_params(spark: SparkSession, a: argparse.Namespace, first: str) -> SketchParams:
    if store.is_collection(first):
        store.require_same_options(kmer=a.kmer, noncanonical=a.noncanonical or None, protein=a.protein or None, alphabet=a.alphabet)
        return store.load_params(spark, first)
    return params_of(a)


def _lines(df: DataFrame) -> Iterator[str]:
    return (r["value"] for r in df.toLocalIterator())


def run(spark: SparkSession, a: argparse.Namespace) -> Iterator[str]:
    """Lines of the command's output."""
    if a.command == "bounds":
        grid = {(r["mode"], r["sketch_size"], r["distance"]): r["bound"] for r in stats.bounds(spark, a.kmer, a.probability).collect()}
        yield from ("", "Parameters:", f"   k:   {a.kmer}", f"   p:   {a.probability:g}", "")
        for mode, title in (("distance", "Sketch distance"), ("screen", "Screen distance")):
            yield f"\t{title}"
            yield "\t".join(["Sketch", *(f"{d:g}" for d in stats.BOUND_DISTANCES)])
            for size in stats.BOUND_SIZES:
                yield "\t".join([f"{size}", *(f"{grid[mode, size, d]:g}" for d in stats.BOUND_DISTANCES)])
            yield ""
    elif a.command == "paste":
        store.paste(spark, a.output, sequences.read_list(spark, *a.inputs) if a.lists else a.inputs)
    elif a.command == "info":
        params = store.load_params(spark, a.collection)
        if a.header:
            yield from (f"{k}\t{v}" for k, v in info.header(params, store.count(spark, a.collection)).items())
            return
        rows, _ = store.load(spark, a.collection)
        if a.dump:
            yield info.dump(rows, params)
        elif a.histogram:
            if not params.counts:
                raise ValueError("the collection has no counts")
            yield from _lines(formats.histogram_lines(info.histogram(rows)))
        else:
            yield "#Hashes\tLength\tID\tComment"
            yield from (f"{r['hashes']}\t{r['length']}\t{r['name']}\t{r['comment']}" for r in info.tabular(rows).orderBy("ref_idx").toLocalIterator())
    elif a.command == "sketch":
        params = params_of(a)
        paths = sequences.read_list(spark, *a.inputs) if a.lists else a.inputs
        # all read files make one sketch
        files = [_stored(spark, p) for p in paths]
        rows = sketch.sketch(sequences.read_sequences(spark, files), params) if params.reads else _read(spark, files, params, False)
        name = a.name
        if name is None and paths[0] == "-":  # named after its first record
            first = sequences.read_sequences(spark, files[:1]).where(F.octet_length("seq") >= params.kmer).agg(F.min_by("name", "rec_no")).first()
            name = first[0]
        rows = written(sketch.renamed(rows, name, a.comment), "sketches")
        if not rows.take(1):
            raise ValueError("no sequence is long enough")
        for r in sketch.low_kmer_warning(rows, params).collect():
            print(f"k-mer size {params.kmer} is small for {r['n_flagged']} sequences, the longest {r['longest']}: at least {r['min_kmer']} is advised", file=sys.stderr)
        store.save(rows, params, store.default_path(paths[0], a.output))
    elif a.command == "triangle":
        a.individual = a.individual or len(a.inputs) == 1 and not a.lists
        params = _own_params(spark, a, a.inputs[0])
        rows = _read(spark, a.inputs, params, a.lists)
        if a.comments:
            rows = rows.withColumn("name", F.col("comment"))
        edges = compare.triangle(rows, params, a.max_distance, a.max_p_value)
        if a.edges or a.max_distance < 1 or a.max_p_value < 1:
            yield from _lines(formats.edge_lines(edges))
        else:
            yield from _lines(formats.triangle_lines(compare.triangle_rows(edges, rows)))
    elif a.command in ("dist", "within"):
        params = _own_params(spark, a, a.inputs[0])
        refs, queries = _read(spark, a.inputs[:1], params, False), _read(spark, a.inputs[1:], params, a.lists)
        if a.command == "within":
            out = compare.within(refs, queries, params, a.max_error).orderBy("query", "ref")
            yield from (f"{r['score']:g}\t{r['error']:g}\t{r['ref_name']}\t{r['query_name']}" for r in out.toLocalIterator())
        elif a.table:
            names = [r["name"] for r in refs.orderBy("ref_idx").toLocalIterator()]
            yield "\t".join(["#query", *names])
            out = compare.dist_table(compare.dist(refs, queries, params, a.max_distance, a.max_p_value), refs)
            for r in out.toLocalIterator():
                yield "\t".join([r["query_name"], *("" if x is None else f"{x:g}" for x in r[2:])])
        else:
            yield from _lines(formats.dist_lines(compare.dist(refs, queries, params, a.max_distance, a.max_p_value, comments=a.comments)))
    elif a.command in ("screen", "taxscreen"):
        refs, params = store.load(spark, a.collection)
        mixture = sequences.read_sequences(spark, [_stored(spark, p) for p in a.inputs])
        if a.command == "screen":
            yield from _lines(formats.screen_lines(screen.screen(refs, mixture, params, a.winner, a.min_identity, a.max_p_value)))
        else:
            nodes = taxonomy.resolved(dumps.read_taxonomy(spark, f"{a.taxonomy}/nodes.dmp", f"{a.taxonomy}/names.dmp"))
            mapping = dumps.read_mapping(spark, a.mapping) if a.mapping else None
            taxa = taxonomy.hash_taxa(refs, taxonomy.reference_taxa(refs, mapping), nodes)
            yield from _lines(formats.report_lines(taxonomy.report(taxonomy.taxon_counts(taxa, screen.mixture_counts(mixture, params, refs=refs)), nodes)))
    elif a.command == "find":
        params = params_of(a)
        number = lambda path, idx: sequences.read_sequences(spark, [path]).select(F.col("rec_no").alias(idx), "name", F.col("seq").cast("string").alias("seq"))
        out = find.find(number(a.inputs[0], "ref_idx"), number(a.inputs[1], "query"), params, a.window, None, a.threshold, a.best, a.exclude_self)
        for r in out.orderBy("query", F.desc("score"), "ref_idx", "start").toLocalIterator():
            yield f"{r['query_name']}\t{r['ref_name']}\t{r['start']}\t{r['end']}\t{'-' if r['minus'] else '+'}\t{r['score']:g}"


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("quillmer")
    if getattr(a, "cores", None) and SparkSession.getActiveSession() is None and "spark.master" not in dict(builder._options):
        builder = builder.master(f"local[{a.cores}]")
    spark = builder.getOrCreate()
    try:
        for line in run(spark, a):
            print(line)
    except ValueError as e:
        print(f"quillmer: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
