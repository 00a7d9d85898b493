"""The query language: tokens, parsing, two-valued logic, collections, full text, vectors, space, paging, deletes."""

import pytest

from tessera.plans.catalog import Catalog
from tessera.plans.compiler import QueryError
from tessera.plans.lexer import QuerySyntaxError, tokens
from tessera.plans.parser import parse
from tessera.plans.query import query


def ids(q):
    return sorted(r[0] for r in q.df().select("id").collect())


@pytest.fixture(scope="module")
def catalog(spark):
    c = Catalog()
    c.register(
        "Person",
        spark.createDataFrame(
            [(1, "John", "M", 25, [7, 3], [("red", 7), ("blue", 3)]), (2, "Jane", None, 30, [3, 0], [("red", 3), ("blue", 7)]), (3, None, "F", None, [], []), (4, "a\nb", "F", 30, None, None)],
            "id int, name string, gender string, age int, numbers array<int>, team array<struct<color string, number int>>",
        ),
        key="id", nested=frozenset({"team"}),
    )
    c.register("Flat", c["Person"].df, key="id")
    c.register(
        "Doc",
        spark.createDataFrame([(1, "The bus fare is high", 5), (2, "canceling a bus for a fee", 20), (3, "boat and moat running", 50), (4, None, None)], "id int, t string, n int"),
        key="id", analyzers={"t": "standard", "n": "keyword"}, version="n",
    )
    c.register("Stem", c["Doc"].df, analyzers={"t": "stemmer"})
    c.register("Item", spark.createDataFrame([(i, [1.1 * i] * 3, ["cat", "dog", "cow"][i % 3]) for i in range(1, 51)], "id int, v array<float>, buggy string"), key="id", similarity={"v": "L2"}, analyzers={"buggy": "standard"})
    c.register("Place", spark.createDataFrame([(1, 41.0, 2.0), (2, 42.0, 12.0), (3, None, None)], "id int, latitude double, longitude double"), key="id", points={"loc": ("latitude", "longitude")})
    return c


def test_tokens():
    kinds = [(t.kind, t.value) for t in tokens("a 0x1F 017 12L 1.5f 'it''s' \"q\" `odd name`")[:-1]]
    assert kinds == [("name", "a"), ("int", 31), ("int", 15), ("int", 12), ("float", 1.5), ("string", "it's"), ("string", "q"), ("name", "odd name")]
    with pytest.raises(QuerySyntaxError):
        tokens("from X where a : /open")


@pytest.mark.parametrize("bad", ["select from X", "from X where", "from X where a", "from X where upper(a) = 1", "from X order by", "from X where a = 1 extra stuff", "from X where a within star(1)"])
def test_bad_queries(bad):
    with pytest.raises(QuerySyntaxError):
        parse(bad)


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("age > 26", [2, 4]), ("not age > 26", [1, 3]), ("age <> 30", [1]), ("gender = 'M' or age = 30", [1, 2, 4]), ("gender is null", [2]), ("name is not null and !(gender = 'F')", [1, 2]),
        ("age in (25, 30)", [1, 2, 4]), ("age not in (25)", [2, 3, 4]), ("name like 'J%n'", [1]), ("name like '_a%'", [2]), ("name like 'a%b'", [4]), ("age between 25 and 29", [1]), ("30 <= age", [2, 4]),
        ("numbers = 7", [1]), ("numbers > 2", [1, 2]), ("team.color = 'red' and team.number = 3", [1, 2]), ("0 member of numbers", [2]), ("numbers is empty", [3]), ("true", [1, 2, 3, 4]), ("false or age = 25", [1]),
    ],
)
def test_conditions(catalog, where, want):
    assert ids(query(catalog, f"from Person where {where}")) == want


def test_joins(catalog):
    red3 = "p.color = 'red' and p.number = 3"
    assert ids(query(catalog, f"select t.id from Person t join t.team p where {red3}")) == [2]
    assert ids(query(catalog, f"select t.id from Flat t join t.team p where {red3}")) == [1, 2]
    assert ids(query(catalog, "select t.id from Person t join t.team p join t.team q where p.number = 7 and p.color = 'red' and q.number = 3 and q.color = 'blue'")) == [1]
    assert ids(query(catalog, "select t.id from Person t join t.team p where p.number = 3 and p.number != 7")) == []
    assert [r["numbers"] for r in query(catalog, "select id, numbers from Person order by id").df().collect()] == [7, 3, None, None]


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("t : 'BUS'", [1, 2]), ("t : 'bus fare'", [1]), ("t : 'canceling fee'~4", [2]), ("t : 'canceling fee'~1", []), ("t : 'bsu'~2", [1, 2]), ("t : 'bo?t'", [3]), ("t : 'can*'", [2]), ("t : /[mb]oat/", [3]),
        ("t : ('bus' -'fare')", [2]), ("t : (+'bus' and not 'fee')", [1]), ("n : [5 to 20]", [1, 2]), ("n : {5 to *]", [2, 3]), ("not t : 'bus'", [3, 4]), ("t : :w", [1, 2]), ("t : 'bus'^2 and #t : 'fee'", [2]),
    ],
)
def test_full_text(catalog, where, want):
    assert ids(query(catalog, f"from Doc where {where}", w="bus")) == want


def test_stems_and_scores(catalog):
    assert ids(query(catalog, "from Stem where t : 'runs'")) == [3]
    rows = query(catalog, "select d.id, score(d), version(d) from Doc d where d.t : ('bus'^5 or 'boat') order by score(d) desc, id").df().collect()
    assert [(r["id"], r["version"]) for r in rows] == [(1, 5), (2, 20), (3, 50)]
    assert rows[0]["score"] == pytest.approx(5.0) and rows[2]["score"] == pytest.approx(1.0)


def test_vectors(catalog):
    assert ids(query(catalog, "from Item where v <-> [7, 7, 7]~3")) == [5, 6, 7]
    assert ids(query(catalog, "from Item where v <-> :v~:k filtering buggy : 'cat'", v=[7, 7, 7], k=3)) == [3, 6, 9]
    best = query(catalog, "select id, score(i) as s from Item i where v <-> [:a, :a, :a]~1", a=1.1).df().collect()
    assert best[0]["id"] == 1 and best[0]["s"] == pytest.approx(1.0, abs=1e-6)


def test_space(catalog):
    assert ids(query(catalog, "from Place where loc within circle(41.0, 2.5, 50, km)")) == [1]
    assert ids(query(catalog, "from Place where loc within box(43, 1, 40, 3)")) == [1]
    assert ids(query(catalog, "from Place where loc within polygon((40, 11), (40, 13), (44, 13), (44, 11))")) == [2]
    assert query(catalog, "select distance(loc, 41.0, 2.0, mi) as d from Place where id = 2").df().first()["d"] == pytest.approx(521.76, abs=0.1)


def test_grouping(catalog):
    rows = query(catalog, "select age, count(*), count(name) as n, sum(age) from Person group by age having count(*) >= 1 order by age desc").df().collect()
    assert [tuple(r) for r in rows] == [(30, 2, 2, 60), (25, 1, 1, 25), (None, 1, 0, None)]
    with pytest.raises(QueryError):
        query(catalog, "select name, count(*) from Person group by age").df()
    with pytest.raises(QueryError):
        query(catalog, "select sum(name) from Person").df()


def test_paging_parameters_and_delete(catalog, spark):
    c = Catalog()
    c.register("Game", spark.range(110).withColumnRenamed("id", "n"), key="n")
    found = query(c, "from Game").execute()
    assert (len(found.rows), found.hit_count, found.exact) == (100, 110, True)
    assert query(c, "from Game").hit_count(50) == (50, False)
    assert [r["n"] for r in query(c, "from Game order by n").start_offset(5).max_results(2).df().collect()] == [5, 6]
    with pytest.raises(QueryError, match="'low' was not set"):
        query(c, "from Game where n > :low").df()
    with pytest.raises(QueryError):
        query(c, "delete from Game").max_results(1).delete()
    assert query(c, "delete from Game where n >= :low", low=100).delete() == 10
    assert query(c, "from Game").hit_count() == (100, True)
    with pytest.raises(KeyError):
        query(c, "from Nothing").df()


def test_statistics_and_tasks(spark):
    from tessera.operators.tasks import Task, Tasks

    catalog = Catalog()
    catalog.register("n", spark.range(5))
    for _ in range(3):
        query(catalog, "select id from n where id > 1").execute()
    row = catalog.statistics.df(spark).first()
    assert (row["count"], row["rows"]) == (3, 9) and row["max_seconds"] >= row["mean_seconds"] > 0
    assert catalog.statistics.slowest()[0] == "select id from n where id > 1"
    catalog.statistics.clear()
    assert catalog.statistics.slowest() is None
    tasks = Tasks(spark, catalog)
    tasks.register(Task("ask", lambda spark, context, least: context.query("select id from n where id > :x", x=least).df()))
    assert tasks.execute("ask", least=3).count() == 1


def test_hit_count_of_all(spark):
    c = Catalog()
    c.register("Game", spark.range(10_050).withColumnRenamed("id", "n"), key="n")
    assert query(c, "from Game").hit_count() == (10_000, False) and query(c, "from Game").hit_count(None) == (10_050, True)
