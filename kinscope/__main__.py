"""python -m kinscope mock|build|query|benchmark|study|search: thin commands over the library."""

from __future__ import annotations

import argparse

from kinscope.config import METRICS, SCHEMES, Config
from kinscope.operators import benchmark, case_study, search, service
from kinscope.plans.build import Workspace, build_dataset, build_engine, ensure_built, load, write_manifest, write_regime
from kinscope.runtime import session
from kinscope.sources import bundle, mock


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kinscope")
    p.add_argument("--folder", required=True, help="the workspace")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("mock", help="write the synthetic dataset").add_argument("--seed", type=int, default=mock.SEED)
    b = sub.add_parser("build", help="build the engine, out of a bundle where one is given")
    b.add_argument("--bundle")
    b.add_argument("--scheme", choices=SCHEMES, default="smooth_idf")
    b.add_argument("--min-features", type=int, default=5)
    b.add_argument("--skip-clusters", action="store_true")
    q = sub.add_parser("query", help="ask for the nearest entities")
    q.add_argument("features")
    q.add_argument("--metric", choices=METRICS, default="cosine")
    q.add_argument("--top-k", type=int, default=10)
    m = sub.add_parser("benchmark", help="run a regime")
    m.add_argument("--regime", choices=sorted(benchmark.REGIMES), default="A")
    m.add_argument("--repeats", type=int, default=20)
    sub.add_parser("study", help="a close look at one entity").add_argument("entity")
    sub.add_parser("search", help="features by text").add_argument("text")
    args = p.parse_args(argv)
    spark = session()
    space = Workspace(spark, args.folder)
    if args.command == "mock":
        rows = mock.entities(spark, args.seed)
        build_dataset(space, rows, mock.edges(rows), mock.catalogue(spark))
        mock.ground_truth(rows).write.mode("overwrite").parquet(f"{args.folder}/ground_truth.parquet")
        write_manifest(space, "synthetic", seed=str(args.seed))
    elif args.command == "build":
        if args.bundle:
            from kinscope.operators.normalize import normalize

            parsed = bundle.parse(bundle.read_objects(spark, args.bundle))
            done = normalize(parsed.entities, parsed.features, parsed.uses, args.min_features)
            build_dataset(space, done.entities, done.edges, done.catalogue)
            write_manifest(space, args.bundle, version=str(bundle.version(bundle.read_objects(spark, args.bundle)).first()["version"]))
        build_engine(space, Config(scheme=args.scheme), with_clusters=not args.skip_clusters)
    else:
        ensure_built(space)
        if args.command == "query":
            service.check_request(args.features, args.top_k)
            own = load(space, Config(metric=args.metric))
            print(service.markdown(own.ask(service.parse_features(spark, args.features), args.top_k)))
        elif args.command == "benchmark":
            report, test = benchmark.run_regime(space.read("edges"), args.regime, repeats=args.repeats)
            write_regime(space, report, test, args.regime)
            print(case_study.text_table(report.orderBy("run", "dimension", "value")), case_study.text_table(test), sep="\n\n")
        elif args.command == "study":
            for name, df in case_study.case_study(space.read("space"), space.read("weights"), args.entity).items():
                print(f"## {name}", case_study.text_table(df), sep="\n")
        else:
            from kinscope.operators.weighting import heat

            print(case_study.text_table(search.search_features(heat(space.read("weights")), args.text)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
