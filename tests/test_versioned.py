"""Stored lists that are replaced version by version."""

import pytest

from kassenwerk.operators import terminals
from kassenwerk.sources.versioned import Version, VersionConflict, VersionedTable

DELIVERED = "seq long, identifier string, name string, space string, space_id string"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"{tmp_path}/list", terminals.STORED)


@pytest.fixture
def delivery(spark):
    return lambda *rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DELIVERED)


def listed(table):
    return {r.id: (r.label, r.selected) for r in table.rows().collect()}


def test_a_new_table_is_empty(table):
    assert table.current() == Version(0, None, ()) and table.rows().count() == 0


def test_a_delivery_saved_twice_counts_once(table, delivery):
    given = delivery(("G1", "Garten", None, None), ("G2", "Gang", None, None))
    first = terminals.save_delivery(table, given, "monday").first()
    assert tuple(first) == (2, 0) and table.current().number == 1
    assert tuple(terminals.save_delivery(table, given, "monday").first()) == (0, 0) and table.current().number == 1
    later = delivery(("G2", "Gang Nord", None, None), ("G3", "Galerie", None, None))
    assert tuple(terminals.save_delivery(table, later, "tuesday").first()) == (1, 1)
    assert listed(table) == {"G1": ("Garten", True), "G2": ("Gang Nord", True), "G3": ("Galerie", True)}
    # The first job, started again late, finds its work done and does not undo the second.
    terminals.save_delivery(table, given, "monday")
    assert listed(table)["G2"] == ("Gang Nord", True) and table.current().number == 2


def test_a_write_that_ends_before_its_manifest_changes_nothing(spark, table, delivery, monkeypatch):
    terminals.save_delivery(table, delivery(("G1", "Garten", None, None)), "monday")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched, pytest.raises(KeyboardInterrupt):
        read = table.current()
        rows = table.rows(read).limit(0)
        patched.setattr(VersionedTable, "_manifest", killed)
        table.replace(rows, read, "lost")
    assert table.current().number == 1 and listed(table) == {"G1": ("Garten", True)}
    again = VersionedTable(spark, table.root, terminals.STORED)
    terminals.save_delivery(again, delivery(("G9", "Grotte", None, None)), "lost")
    assert set(listed(table)) == {"G1", "G9"}


def test_of_two_writers_one_is_refused(spark, table, delivery):
    terminals.save_delivery(table, delivery(("G1", "Garten", None, None)), "monday")
    read = table.current()
    rows = table.rows(read)
    table.replace(rows, read, "one")
    with pytest.raises(VersionConflict):
        table.replace(rows, read, "other")
    assert table.current().operations == ("monday", "one")


def test_a_selection_writes_only_real_changes(table, delivery):
    given = delivery(("G1", "Garten", "4410 · Olten", "4410"), ("G2", "Gang", None, None))
    terminals.save_delivery(table, given, "monday")
    assert terminals.save_selection(table, "4410", True, "on").first().geaendert == 0 and table.current().number == 1
    assert terminals.save_selection(table, "4410", False, "off").first().geaendert == 1
    assert terminals.save_selection(table, "4410", False, "off").first().geaendert == 0
    assert listed(table) == {"G1": ("Garten", False), "G2": ("Gang", True)} and table.current().number == 2
