"""Run-metric tables: append rows (K5), read them back (S11), file size/line profile."""

import os

from stratum.operators.profile import group_mean, stage_report, unpivot_metrics
from stratum.sinks.writers import append_row
from stratum.sources.clean import METRICS_M1, PROFILE_M2, read_metrics_csv
from stratum.sources.files import text_line_profile


def test_metrics_tables(spark, scratch):
    path = os.path.join(scratch, "run_metrics")
    for env, eng, total in [("1y", "spark", 3.0), ("1y", "spark", 5.0), ("2y", "spark", 7.0)]:
        append_row(spark, path, {"environment": env, "engine": eng, "extract_data": total / 2,
                                 "transform_data": 0.5, "load_to_clean": 0.25, "concatenate_monthly_data": 0.0,
                                 "export_monthly_data": 0.1, "concatenate_category_data": 0.0,
                                 "export_category_data": 0.1, "total_etl_time": total}, METRICS_M1)
    m = spark.read.parquet(path)
    assert m.count() == 3
    means, steps = stage_report(m)
    got = {(r.environment, r.engine): r.total_etl_time for r in means.collect()}
    assert got == {("1y", "spark"): 4.0, ("2y", "spark"): 7.0}
    assert steps.count() == 3 * 7
    assert group_mean(m, ["environment"], "extract_data").count() == 2

    # equal rows of an appending harness are all kept
    csv = os.path.join(scratch, "environments.csv")
    with open(csv, "w") as fh:
        fh.write("environment,initial_clean_dataframe_size_MB,num_files,num_lines\n")
        fh.write("1y,0.5,15,1000\n1y,0.5,15,1000\n2y,1.0,15,2000\n")
    env = read_metrics_csv(spark, csv, PROFILE_M2)
    assert env.count() == 3
    long_df = unpivot_metrics(env, "environment", ["num_files", "num_lines"], "Atributos", "qtd")
    assert long_df.count() == 6


def test_text_line_profile(spark, scratch):
    folder = os.path.join(scratch, "clean_csv")
    os.makedirs(folder)
    with open(os.path.join(folder, "a.csv"), "w") as fh:
        fh.write('"h"\n"x"\n"multi\nline"\n')
    with open(os.path.join(folder, "b.csv"), "w") as fh:
        fh.write('"h"\n')
    prof = {os.path.basename(r.path): (r.length, r.num_lines) for r in text_line_profile(spark, folder).collect()}
    assert prof["a.csv"][1] == 4 and prof["b.csv"][1] == 1
    assert prof["a.csv"][0] == len('"h"\n"x"\n"multi\nline"\n')
