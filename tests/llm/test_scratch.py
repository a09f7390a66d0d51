"""Tables in the shared folder: who deletes them, and when."""

import os

import pytest

from gleanery.llm import common


def there(t):
    return any(os.path.exists(f.removeprefix("file://")) for f in t.inputFiles())


def test_nested_scopes(spark):
    """An outer scope that is still empty, and one that holds the same tables, end without confusion."""
    one = lambda: spark.range(3)
    with common.scratch(spark):
        with common.scratch(spark):
            with common.scratch(spark):
                inner, middle = common.stored(one()), common.stored(one(), keep=True)
                files = inner.inputFiles()
            assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
            assert there(middle)
            files = middle.inputFiles()
        assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
        out = common.stored(one(), keep=True)
    assert there(out) and out.count() == 3 and not common._scopes
    files = out.inputFiles()
    common.discard(out)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_scope_ends_after_an_error(spark):
    with pytest.raises(ZeroDivisionError):
        with common.scratch(spark):
            t = common.stored(spark.range(3))
            files = t.inputFiles()
            with common.scratch(spark):
                1 / 0
    assert not common._scopes and not any(os.path.exists(f.removeprefix("file://")) for f in files)
