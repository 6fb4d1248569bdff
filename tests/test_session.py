"""Staged tables and who owns them."""

import os

from flowmill.session import scratch_scope, stage


def test_scope_frees_what_it_staged_and_keeps_what_is_handed_on(spark):
    def there(table):
        return os.path.isdir(table._staged_at)

    with scratch_scope(spark) as outer:
        first = stage(spark.range(10), "first")
        with scratch_scope(spark) as inner:
            second = stage(first.where("id > 3"), "second", "zstd")
            third = stage(second.where("id > 5"), "third")
            inner.free(second)
            assert not there(second) and there(third)
            fourth = stage(third, "fourth")
            inner.keep(third)
        assert there(third) and not there(fourth) and third.count() == 4
        outer.keep(first)
    assert there(first) and not there(third)
    assert first.count() == 10
