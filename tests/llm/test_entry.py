def test_names():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in (1, 2, 3, 5, 6, 7, 10):
        assert f"p{n}_found" in names
    assert all(any(k.startswith(f"p{n}_") for k in names) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
