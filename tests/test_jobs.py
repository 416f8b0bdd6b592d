from sluice.plans.jobs import register_job, run_job


def test_jobs_run_by_name(spark):
    register_job("joined", lambda a, b, key: a.join(b, key))
    assert run_job("joined", spark.range(5), spark.range(3, 9), key="id").count() == 2
