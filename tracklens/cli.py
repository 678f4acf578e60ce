"""Command line: ``python -m tracklens.cli run|goldset|eval ...`` over the functions of the package."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.lexicon import build
from .plans import evaluate
from .plans.transcribe import PROFILES, run
from .sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracklens")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run", help="audit, merge and write transcripts of all recordings")
    r.add_argument("passes", nargs="+", help="JSON passes, one path or pattern for each pass")
    r.add_argument("--energy", required=True, help="WAV files")
    r.add_argument("--patches")
    r.add_argument("--glossary")
    r.add_argument("--profile", choices=sorted(PROFILES), default="lecture")
    r.add_argument("--phonetic", action="store_true", help="put glossary terms in the place of what sounds like them")
    r.add_argument("--loose", action="store_true", help="take near sounds for one")
    r.add_argument("--speakers", help="JSON lines of recording_id, seg_ord, embedding")
    r.add_argument("--out", required=True)
    g = sub.add_parser("goldset", help="a sheet to correct by hand, from cues")
    g.add_argument("srt")
    g.add_argument("--start", type=float)
    g.add_argument("--end", type=float)
    g.add_argument("--out", required=True)
    e = sub.add_parser("eval", help="score cues against gold sheets, or hypotheses of a manifest")
    e.add_argument("--gold")
    e.add_argument("--hyp")
    e.add_argument("--manifest", help="JSON lines of audio, text, hyp")
    e.add_argument("--limit", type=int, help="score the first so many items of the manifest only")
    e.add_argument("--out")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tracklens").getOrCreate()
    {"run": cmd_run, "goldset": cmd_goldset, "eval": cmd_eval}[args.command](spark, args)


def cmd_run(spark: SparkSession, args: argparse.Namespace) -> None:
    read = [readers.read_pass(spark, path, i) for i, path in enumerate(args.passes)]
    segs = read[0][1]
    for _, more in read[1:]:
        segs = segs.unionByName(more)
    words = readers.read_glossary(spark, args.glossary) if args.glossary else None
    fixes = [(r["wrong"], r["right"]) for r in words["fixes"].orderBy("ord").collect()] if words else []
    terms = [r["term"] for r in words["terms"].orderBy("ord").collect()] if words else []
    leads = [r["lead"] for r in words["leads"].orderBy("ord").collect()] if words else []
    profile = replace(PROFILES[args.profile], phonetic=args.phonetic or args.loose, loose=args.loose)
    vectors = spark.read.schema("recording_id string, seg_ord int, embedding array<double>").json(args.speakers) if args.speakers else None
    patches = readers.read_patches(spark, args.patches) if args.patches else None
    out = run(segs, read[0][0], readers.read_energy(spark, args.energy), patches, fixes, terms, build(spark), profile, leads or None, vectors)
    md, txt = writers.transcript(out["paragraphs"], read[0][0])
    for name, bodies in (("md", md), ("txt", txt), ("srt", writers.srt(out["cues"])), ("json", writers.report(final=out["final"], spans=out["first_spans"], drop=out["first_drop"], breaks=out["breaks"], edits=out["edits"]))):
        writers.write(bodies, f"{args.out}/{name}")
    out["glossary"].coalesce(1).write.mode("overwrite").json(f"{args.out}/glossary")


def cmd_goldset(spark: SparkSession, args: argparse.Namespace) -> None:
    at = lambda s: None if s is None else round(s * 1000)
    writers.write(writers.gold_sheet(readers.read_srt(spark, args.srt), at(args.start), at(args.end)), args.out)


def cmd_eval(spark: SparkSession, args: argparse.Namespace) -> None:
    lexicon = build(spark)
    if args.manifest:
        items = spark.read.schema("audio string, text string, hyp string").json(args.manifest)
        items = items.limit(args.limit) if args.limit is not None else items
        result, name = evaluate.over_manifest(items, lexicon)[0], F.lit("all")
    else:
        result, name = evaluate.against_gold(readers.read_gold(spark, args.gold), readers.read_srt(spark, args.hyp), lexicon), F.col("recording_id")
    result = result.cache()
    for r in result.select(evaluate.summary(name).alias("line")).limit(100).collect():
        print(r["line"])
    if args.out:
        result.write.mode("overwrite").json(args.out)


if __name__ == "__main__":
    main()
