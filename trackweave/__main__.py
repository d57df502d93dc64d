"""``python -m trackweave DIRECTORY SOURCE TARGET``: the cheapest path between two tracks."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from trackweave.engine import Library, Settings
from trackweave.session import session
from trackweave.sources import audio, scan, snapshot


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trackweave", description=__doc__)
    parser.add_argument("directory", help="folder of audio files")
    parser.add_argument("source", help="path or file name of the first track")
    parser.add_argument("target", help="path or file name of the last track")
    parser.add_argument("--library", help="folder of the library's snapshots")
    options = parser.parse_args(args)
    spark = session()
    settings = Settings(base=options.directory)

    def analyse(files):
        content = scan.listing(spark, options.directory, content=True).join(files.select("file_path"), "file_path", "left_semi")
        return scan.numbered(audio.extract(content).where("status = 'ok'"))

    if options.library and snapshot.ORIGINAL in snapshot.versions(spark, options.library):
        library = Library.load(spark, options.library, settings=settings).sync(scan.hashed(spark, options.directory), analyse)
    else:
        library = Library.build(analyse(scan.unique(spark, options.directory)), settings)
    if options.library:
        library.save(options.library, snapshot.ORIGINAL) if library.version == 1 else library.save(options.library, f"sync-{library.version}")
    path = library.path([options.source, options.target])
    for r in path.select("pos", "filename", "bpm", "key", "hop_cost").collect():
        print(f"{r['pos']:>3}  {r['filename']}  {r['bpm']} BPM  {r['key']}  +{r['hop_cost']:.4f}")
    print(library.path_summary(path).select(F.concat_ws(", cost ", "summary", F.col("total_cost").cast("string"))).first()[0])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
