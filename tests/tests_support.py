def lines_of(spark, text, run="r"):
    return spark.createDataFrame([(run, k + 1, x) for k, x in enumerate(text)], "run_id string, n long, raw string")
