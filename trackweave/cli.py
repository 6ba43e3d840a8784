"""Command line: run a query over a folder of tables, localise, adjust keypoints, or show settings."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from trackweave import conf
from trackweave.operators import graph, localize
from trackweave.functions.interpolation import Sampling
from trackweave.operators.adjust import BundleSetup, KeypointOptions, bundle_adjust, refine_keypoints
from trackweave.operators.solver import Options
from trackweave.plans import catalog
from trackweave.runtime import Scratch, build_session
from trackweave.sources import sinks


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="trackweave")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a query over a folder of Parquet tables")
    run.add_argument("name", choices=sorted(catalog.queries()))
    run.add_argument("tables")
    run.add_argument("output")
    keypoints = commands.add_parser("adjust-keypoints", help="refine keypoints along the tracks of a match graph")
    pose = commands.add_parser("localize", help="poses of query images from 2D-3D correspondences")
    pose.add_argument("--patches", action="store_true", help="refine keypoints and poses with the table `patches`")
    for command in (keypoints, pose):
        command.add_argument("tables", help="folder with the input tables in Parquet")
        command.add_argument("output")
        command.add_argument("--config", default="default")
        command.add_argument("settings", nargs="*", help="name=value")
    bundle = commands.add_parser("bundle", help="refine poses, cameras and points of a model by one kind of residual")
    bundle.add_argument("tables", help="folder with the table `observations` in Parquet")
    bundle.add_argument("output")
    bundle.add_argument("--config", default="default")
    bundle.add_argument("settings", nargs="*", help="name=value")
    show = commands.add_parser("config", help="print settings")
    show.add_argument("preset", nargs="?", default="default")
    show.add_argument("settings", nargs="*")
    args = parser.parse_args(arguments)
    if args.command == "config":
        print(json.dumps(conf.load(args.preset, args.settings), indent=2))
        return
    spark = build_session()
    read = lambda name: spark.read.parquet(f"{args.tables}/{name}")
    if args.command == "run":
        catalog.queries()[args.name](spark, args.tables).write.parquet(args.output)
        return
    settings = conf.load(args.config, args.settings)
    if args.command == "localize":
        pnp = settings["localization"]["PnP"]
        options = localize.PoseOptions(pnp["max_error"], pnp["max_trials"], pnp["seed"])
        local, rows = settings["localization"], read("correspondences")
        patches = read("patches") if args.patches else None
        found = localize.localize_all(rows.select("query").distinct(), rows, patches, options=options, qka=local["QKA"]["apply"], qba=local["QBA"]["apply"], feature_threshold=local["QKA"]["feature_inlier_thresh"])
        found.write.parquet(args.output)
        return
    if args.command == "bundle":
        _bundle(spark, read("observations"), settings, args.output)
        return
    scratch, chosen = Scratch(spark, "adjust"), settings["keypoint_adjustment"]
    solver = chosen["optimizer"]
    options = KeypointOptions(Options(solver["max_num_iterations"], solver["parameter_tolerance"], loss_name=solver["loss"]["name"], loss_scale=(solver["loss"]["params"] or [1.0])[0]), bound=solver["bound"], weight_by_sim=solver["weight_by_sim"], root_edges_only=solver["root_edges_only"])
    nodes, edges = (scratch.save(t) for t in graph.build_matching_graph(read("matches")))
    labels = scratch.save(graph.track_labels(nodes, edges, scratch))
    roots = graph.root_labels(labels, graph.score_labels(nodes, edges, labels))
    problems = graph.ka_problem_labels(labels, chosen["max_kps_per_problem"])
    full = scratch.save(nodes.join(labels, "node_idx").join(roots, "node_idx").join(problems, "node_idx"))
    refined, _ = refine_keypoints(full, edges, read("keypoints"), read("patches"), read("images"), scratch, chosen["strategy"], options)
    sinks.write_keypoints(refined, args.output)


def _bundle(spark, observations, settings: dict, output: str) -> None:
    chosen, how = settings["bundle_adjustment"], settings["interpolation"]
    solver = chosen["optimizer"]
    sampling = Sampling(how["mode"], how["l2_normalize"], how["ncc_normalize"], tuple(map(tuple, how["nodes"])), how["check_bounds"])
    options = Options(solver["max_num_iterations"], solver["parameter_tolerance"], solver["function_tolerance"], solver["gradient_tolerance"], solver["loss"]["name"], (solver["loss"]["params"] or [1.0])[0])
    images = [r.image_id for r in observations.select("image_id").distinct().orderBy("image_id").limit(2).collect()]
    setup = BundleSetup.gauge(images, refine_focal=solver["refine_focal_length"], refine_principal=solver["refine_principal_point"], refine_extra=solver["refine_extra_params"], refine_poses=solver["refine_extrinsics"])
    if solver["min_track_length"] > 0:
        observations = observations.join(observations.groupBy("point3d_id").count().where(F.col("count") >= solver["min_track_length"]).select("point3d_id"), "point3d_id", "left_semi")
    poses, cameras, points, _ = bundle_adjust(observations, setup, options, Scratch(spark, "bundle"), chosen["strategy"], sampling)
    pose_rows = [(i, *map(float, q), *map(float, t)) for i, (q, t) in poses.items()]
    tables = {
        "poses": spark.createDataFrame(pose_rows, "image_id bigint, qw double, qx double, qy double, qz double, tx double, ty double, tz double"),
        "cameras": spark.createDataFrame([(c, [float(v) for v in p]) for c, p in cameras.items()], "camera_id bigint, params array<double>"),
        "points3d": points,
    }
    sinks.write_model(tables, output)


if __name__ == "__main__":
    main()
