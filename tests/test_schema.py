from lotstack.operators import topology
from lotstack.plans import schema
from lotstack.plans.views import Tables


def test_tables_are_created_and_dropped(spark):
    schema.create_tables(spark, "lotstack_test")
    assert {t.name for t in spark.catalog.listTables("lotstack_test")} == set(schema.TABLES)
    schema.create_tables(spark, "lotstack_test")
    assert spark.table("lotstack_test.spatial_unit").columns[-1] == "type"
    schema.drop_tables(spark, "lotstack_test")
    spark.sql("DROP DATABASE lotstack_test")


def test_violations(spark):
    units = spark.createDataFrame([("1", "A", None, "s"), ("2", "A", "1", "t"), ("3", "B", "9", None)], "suid string, code string, parent_suid string, source_id string")
    sources = spark.createDataFrame([("s",)], "source_id string")
    found = {name: df.count() for name, df in schema.violations({"spatial_unit": units, "survey_source": sources}).items()}
    assert found == {"unique spatial_unit(code)": 1, "foreign spatial_unit.parent_suid": 1, "foreign spatial_unit.source_id": 1}


def test_table_functions(spark):
    units = Tables(spark, "/root/testdata/sf0.001").view("spatial_units")
    schema.register_validators(spark, units)
    got = spark.sql("SELECT upper_suid, lower_suid FROM validate_vertical_continuity(0.01D)").collect()
    assert sorted(got) == sorted(topology.vertical_gaps(units).select("upper_suid", "lower_suid").collect()) and got
    assert spark.sql("SELECT * FROM validate_3d_adjacency()").count() == topology.adjacency(units).count()
    parcels = units.selectExpr("suid AS parent_suid", "minx AS px1", "miny AS py1", "maxx AS px2", "maxy AS py2")
    outside = spark.sql("SELECT * FROM validate_boundary_alignment(0.01D)").collect()
    assert sorted(outside) == sorted(topology.boundary_violations(units, parcels).collect()) and outside


def test_points_are_grouped_in_parts_of_bounded_size(spark, monkeypatch):
    from lotstack.plans import views

    tables = views.Tables(spark, "/root/testdata/sf0.001")
    whole = sorted(map(tuple, spark.sql(views.VIEWS["points"].replace("FROM lineitem", "FROM {l}"), l=tables.table("lineitem")).collect()))
    monkeypatch.setattr(views, "PART_ROWS", 500)
    dealt = tables.view("points")
    assert dealt.rdd.getNumPartitions() >= 12 and sorted(map(tuple, dealt.collect())) == whole
