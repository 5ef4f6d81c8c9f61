"""Persons and institutions on literal rows."""

from pyspark.sql import functions as F

from factweave.functions import classify as K
from factweave.functions import people as P
from factweave.operators import people

AUTHORS = {"Ann Lee": True, "Lee, Ann": True, "D. V. Lyapinov": True, "Иванов Иван Иванович": True, "Иванов И. О.": True, "Copper Matte": False, "Senior Engineer": False, "University of Lee": False, "Figure One": False, "Auxiliary Facility": False, "Annabel": False, "Lincoln Park": False, "": False}
PAGE = "Report\nAuthors: Ann Lee, Bob Q. Ray\nAffiliation: University of Reno\nProject team:\n1. Carl Moe – engineer\n2. Dora Poe\nООО «Рога» text\nInstitute\nUniversity of Reno at night"


def test_shapes(spark):
    rows = spark.createDataFrame([(n,) for n in AUTHORS], "n string").select("n", K.author_name(P.first_names_first(F.col("n"))).alias("a"), K.person(F.col("n")).alias("p")).collect()
    assert {r.n: r.a for r in rows} == AUTHORS and {r.n: r.p for r in rows} == AUTHORS


def test_harvest(spark):
    texts = spark.createDataFrame([(0, PAGE), (1, "Ann Lee; ANN LEE; Bob Ray"), (2, ""), (3, "Presenters:\n  Ann Lee"), (4, None)], "i int, t string")
    rows = {r.i: r for r in texts.select("i", P.labelled_authors(F.col("t")).alias("a"), P.organisations(F.col("t")).alias("o"), P.numbered_people(F.col("t")).alias("n")).collect()}
    assert rows[0].a == ["Ann Lee", "Bob Q. Ray", "Carl Moe", "Dora Poe"] and rows[0].n == ["Carl Moe", "Dora Poe"]
    assert rows[0].o == ["University of Reno at night", "ООО «Рога»"]
    assert rows[1].a == ["Ann Lee", "Bob Ray"] and rows[2].a == [] and rows[3].a == ["Ann Lee"]


def test_heads_and_documents(spark):
    pages = spark.createDataFrame([(1, 0, "On flows\nAnn Lee\nUniversity of Reno\nCarl Moe\nDora Poe\nJune 2020 Bob Ray\nEva Fox and Gus Hay"), (1, 1, "ANN LEE\nAuthors: Zoe Orr"), (2, 0, None), (3, 0, "Text. " * 100 + "\nDeveloped by Ida Fry")], "doc_id long, chunk_index int, text string")
    heads = people.header_authors(pages.where("doc_id = 1").select(F.col("chunk_index").alias("page_id"), "text"))
    assert [(r.page_id, r.name) for r in heads.orderBy("page_id", "place").collect()] == [(0, "Ann Lee"), (0, "Eva Fox"), (0, "Gus Hay"), (1, "Zoe Orr")]
    got = people.document_people(pages).orderBy("doc_id", "place").collect()
    assert [(r.doc_id, r.name) for r in got] == [(1, "Zoe Orr"), (1, "Ann Lee"), (1, "Eva Fox"), (1, "Gus Hay"), (3, "Ida Fry")]


def test_person_facts(spark):
    rows = [(1, 1, "The moderator Ann Lee said hello. In the World Council; Bob Ray, a man. Steel House, too."), (1, 2, "saidAnn Lee. Ivan Petrovich Sidorov (poet)"), (1, 3, "Tom Fox walks" + "." * 200), (2, 1, "художник Ann Lee"), (2, 2, None)]
    got = people.person_facts(spark.createDataFrame(rows, "question_id int, n int, text string")).collect()
    assert sorted((r.question_id, r.claim, r.sources) for r in got) == [(1, "Ann Lee — moderator", [1, 2]), (1, "Bob Ray — moderator", [1]), (1, "Ivan Petrovich Sidorov — poet", [2]), (2, "Ann Lee", [1])]


def documents(spark, folder, texts):
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")


def same_as_sql(spark, folder, name):
    import duckdb

    from factweave import queries

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    rows = [tuple(r) for r in queries.QUERIES[name](spark, folder).collect()]
    assert sorted(rows) == sorted(db.execute(queries.ORACLE_SQL[name]).fetchall())
    return rows


def test_persons_of_any_words(spark, tmp_path):
    """Words with the end of a patronymic, a verb of speech or a role in them are names as others are, and a name is not looked for inside of others."""
    tail = " aaa bbb ccc ddd eee fff"
    documents(spark, str(tmp_path), [(0, "ann des des levich authors poet zzz" + tail), (50, "thstated statedor ann birchard aab aac" + tail), (100, "artistic membership thor thin aad aae" + tail), (150, "thor thinly hor thin aaf aag" + tail), (200, "uneaiquevich les noted russian aah aai" + tail), (1, None)])
    rows = same_as_sql(spark, str(tmp_path), "persons_in_excerpts")
    assert ("Levich Authors", "Levich Authors", "1") in [r[1:] for r in rows] and ("Hor Thin", "Hor Thin", "4") in [r[1:] for r in rows]


def test_institutions_of_any_words(spark, tmp_path):
    """Words that hold a mark of noise, alone or where two meet, are names of institutions as others are."""
    head = "aaa bbb ccc ddd eee fff "
    documents(spark, str(tmp_path), [(0, head + "copyright stable zza zzb zzc zzd"), (1, head + "cota ble zza zzb zzc zzd"), (2, head + "http www zza zzb zzc zzd"), (3, head + "tag ext zza zzb zzc zzd"), (4, None)])
    assert len(same_as_sql(spark, str(tmp_path), "document_institutions")) == 8
