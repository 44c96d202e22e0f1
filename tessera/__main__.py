"""Command line: list queries, run one over a folder of tables, write or check the proof of a window.

    python -m tessera list
    python -m tessera run NAME DATA OUT
    python -m tessera prepare CITY FILES OUT
    python -m tessera build DATA INDEX
    python -m tessera query INDEX PROOF RESULTS MIN_LON MIN_LAT MAX_LON MAX_LAT START END
    python -m tessera prove DATA PROOF RESULTS
    python -m tessera cross-range tree|lists|keys|boxes DATA OUT [REPEATS]
    python -m tessera scaling|update|point-scaling|point-update DATA OUT
    python -m tessera compare MATRIX MATRIX MEASURE
    python -m tessera all SETTINGS
    python -m tessera check PROOF RESULTS ROOT MIN_LON MIN_LAT MAX_LON MAX_LAT START END
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tessera import config, experiments
from tessera.operators import index_store, proofs
from tessera.plans import analytics, authenticated
from tessera.plans.queries import QUERIES
from tessera.plans.world import MAIN
from tessera.sources import trajectories


def session() -> SparkSession:
    return SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str]) -> int:
    known = QUERIES | analytics.QUERIES | authenticated.QUERIES
    match args:
        case ["list"]:
            print("\n".join(sorted(known)))
        case ["run", name, data, out] if name in known:
            known[name](session(), data).write.parquet(out)
        case ["prove", data, proof, results]:
            spark = session()
            built = authenticated.main_tree(spark, data)
            proofs.save(proofs.proof_tokens(*built, spark.sql(MAIN)), "main", proof, results)
            print(built[0].where("path = ''").first()["hash"])
        case ["cross-range", engine, data, out, *repeats] if engine in experiments.ENGINES and len(repeats) < 2:
            experiments.cross_range(session(), data, out, engine, *map(int, repeats))
        case ["scaling" | "update" | "point-scaling" | "point-update" as name, data, out]:
            getattr(experiments, name.replace("-", "_"))(session(), data, out)
        case ["all", path]:
            own = config.Settings.load(path)
            for engine in experiments.ENGINES:
                experiments.cross_range(session(), own.data, f"{own.out}/{engine}", engine, own.repeats, own.warmups)
            for run in (experiments.scaling, experiments.update, experiments.point_scaling, experiments.point_update):
                run(session(), own.data, own.out)
        case ["prepare", city, files, out]:
            rows = trajectories.read_city(session(), city, files)
            rows.write.parquet(f"{out}/trajectories")
            trajectories.problems(rows).write.parquet(f"{out}/problems")
            (trajectories.csv_segments if city == "beijing" else trajectories.city_segments)(rows).write.parquet(f"{out}/segments")
        case ["build", data, index]:
            tree, records, mmr, leaves = authenticated.main_tree(session(), data)
            root = tree.where("path = ''").first()["hash"]
            print(index_store.save({"tree": tree, "records": records, "mmr": mmr, "leaves": leaves}, index, root, theta=authenticated.THETA)["root"])
        case ["query", index, proof, results, *window] if len(window) == 6:
            tables, manifest = index_store.load(session(), index)
            asked = session().createDataFrame([("asked", *map(float, window[:4]), *map(int, window[4:]))], "query_id string, min_lon double, min_lat double, max_lon double, max_lat double, q_start long, q_end long")
            proofs.save(proofs.proof_tokens(*(tables[t] for t in ("tree", "records", "mmr", "leaves")), asked), "asked", proof, results)
            print(manifest["root"])
        case ["compare", a, b, measure]:
            apart = config.reconcile(*(config.read_matrix(session(), x, measure) for x in (a, b)), measure).collect()
            print("\n".join(map(str, apart)))
            return int(bool(apart))
        case ["check", proof, results, root, *window] if len(window) == 6:
            try:
                ids = proofs.verify_files(proof, results, [*map(float, window[:4]), *map(int, window[4:])], root)
            except proofs.Rejected as e:
                print(f"rejected: {e}", file=sys.stderr)
                return 1
            print("\n".join(sorted(ids)))
        case _:
            print(__doc__, file=sys.stderr)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
