"""Small tables with results and lineage worked out by hand, every contributing row on every side."""

import pytest

from rowtrail import Trail, aggregate, join
from rowtrail.operators import lineage


@pytest.fixture
def port(source):
    """Ships that call at berths, and the crates they unload; one ship never calls, one call has no crates."""

    class Port:
        trail = Trail()
        ships = source(trail, "ships", "ship string, flag string", ("Ada", "NO"), ("Brig", "PT"), ("Cog", "NO"), ("Dhow", None))
        calls = source(
            trail, "calls", "call bigint, ship string, berth bigint, hours double",
            (70, "Ada", 1, 5.0), (71, "Cog", 2, 8.0), (72, "Ada", 2, 3.0), (73, "Brig", 1, None),
        )
        crates = source(
            trail, "crates", "call bigint, goods string, kg bigint",
            (70, "tea", 30), (70, "salt", 50), (71, "tea", 10), (72, "salt", 20), (72, "salt", 25), (99, "rope", 5),
        )

    return Port


def values(t, *columns):
    return sorted((tuple(r) for r in t.untracked().select(*columns).collect()), key=str)


def test_ids_are_positions_and_none_is_missing(port):
    assert lineage.rows_without_lineage(port.calls).count() == 0
    found = {r["ship"]: r["token"] for r in lineage.token_edges(port.ships, ["ship"]).collect()}
    assert found == {"Ada": "ships:0", "Brig": "ships:1", "Cog": "ships:2", "Dhow": "ships:3"}
    assert port.trail.source(port.ships, "ships", row_key="n") is port.ships


def test_inner_join_carries_both_sides(port, tokens):
    assert tokens(join(port.ships, port.calls, on="ship"), "call") == {
        70: {"ships:0", "calls:0"}, 71: {"ships:2", "calls:1"}, 72: {"ships:0", "calls:2"}, 73: {"ships:1", "calls:3"},
    }


def test_outer_joins_leave_the_missing_side_out(port, tokens):
    left = join(port.ships, port.calls.select("ship", "call"), on="ship", how="left")
    assert tokens(left.filter("call is null"), "ship") == {"Dhow": {"ships:3"}}
    right = join(port.calls.select("call", "berth"), port.crates, on="call", how="right")
    assert values(right.filter("berth is null"), "call", "berth", "goods") == [(99, None, "rope")]
    assert tokens(right, "kg") == {
        30: {"calls:0", "crates:0"}, 50: {"calls:0", "crates:1"}, 10: {"calls:1", "crates:2"},
        20: {"calls:2", "crates:3"}, 25: {"calls:2", "crates:4"}, 5: {"crates:5"},
    }


def test_filters_keep_the_lineage_of_what_stays(port, tokens, spark):
    joined = join(port.calls, port.crates, on="call")
    assert tokens(joined.filter("kg > 20 AND berth = 1"), "kg") == {30: {"calls:0", "crates:0"}, 50: {"calls:0", "crates:1"}}
    wanted = {10: {"calls:1", "crates:2"}, 30: {"calls:0", "crates:0"}}
    assert tokens(joined.where_in("goods", ["tea", "wine"]), "kg") == wanted
    assert tokens(joined.where_in("goods", spark.createDataFrame([("tea",), ("wine",)], "g string")), "kg") == wanted


def test_sums_over_a_left_join(port, tokens):
    t = aggregate(join(port.calls, port.crates, on="call", how="left"), "ship", {"kg": "sum", "hours": "mean"})
    assert values(t, "ship", "kg", "hours") == [("Ada", 125, 4.0), ("Brig", 0, None), ("Cog", 10, 8.0)]
    assert tokens(t, "ship") == {
        "Ada": {"calls:0", "calls:2", "crates:0", "crates:1", "crates:3", "crates:4"}, "Brig": {"calls:3"}, "Cog": {"calls:1", "crates:2"},
    }


BY_GOODS = {"tea": {"crates:0", "crates:2"}, "salt": {"crates:1", "crates:3", "crates:4"}, "rope": {"crates:5"}}


@pytest.mark.parametrize(
    ("spec", "named", "columns", "expected"),
    [
        ("sum", {}, ["kg"], [("rope", 5), ("salt", 95), ("tea", 40)]),
        (["min", "max"], {}, ["kg_min", "kg_max"], [("rope", 5, 5), ("salt", 20, 50), ("tea", 10, 30)]),
        ({"kg": "count"}, {}, ["kg"], [("rope", 1), ("salt", 3), ("tea", 2)]),
        ({"kg": ["sum", "mean"]}, {}, ["kg_sum", "kg_mean"], [("rope", 5, 5.0), ("salt", 95, 95 / 3), ("tea", 40, 20.0)]),
        ({"heaviest": ("kg", "max")}, {}, ["heaviest"], [("rope", 5), ("salt", 50), ("tea", 30)]),
        (None, {"kinds": ("kg", "nunique")}, ["kinds"], [("rope", 1), ("salt", 3), ("tea", 2)]),
        (None, {}, [], [("rope",), ("salt",), ("tea",)]),
    ],
)
def test_every_form_of_an_aggregate(port, tokens, spec, named, columns, expected):
    t = aggregate(port.crates.select("goods", "kg"), "goods", spec, **named)
    assert values(t, "goods", *columns) == expected
    assert tokens(t, "goods") == BY_GOODS


def test_an_aggregate_over_an_aggregate_joined_back(port, tokens):
    per_call = aggregate(port.crates, "call", kg=("kg", "sum"))
    per_ship = aggregate(join(port.calls, per_call, on="call", how="left"), "ship", most=("kg", "max"))
    t = join(port.ships, per_ship, on="ship", how="left")
    assert values(t, "ship", "most") == [("Ada", 80), ("Brig", None), ("Cog", 10), ("Dhow", None)]
    assert tokens(t, "ship") == {
        "Ada": {"ships:0", "calls:0", "calls:2", "crates:0", "crates:1", "crates:3", "crates:4"},
        "Brig": {"ships:1", "calls:3"}, "Cog": {"ships:2", "calls:1", "crates:2"}, "Dhow": {"ships:3"},
    }


def test_the_whole_frame(port, tokens):
    t = aggregate(port.crates.select("kg"), (), "sum")
    assert values(t, "kg") == [(140,)]
    assert tokens(t, "kg") == {140: {f"crates:{i}" for i in range(6)}}


def test_two_runs_tell_the_same(port):
    def run():
        t = aggregate(join(port.calls, port.crates, on="call").filter("kg >= 20"), "berth", kg=("kg", "sum"), n=("goods", "count"))
        return lineage.decoded(t)

    first = run()
    assert sorted((r["berth"], r["kg"], r["n"]) for r in first.collect()) == [(1, 80, 2), (2, 45, 2)]
    assert lineage.differences(first, run()).count() == 0
