"""How often the stream of progress calls its state: each call is a message to the JVM."""

from types import SimpleNamespace

from evidentia.streaming import progress


class Handle:
    """States in memory that count their calls."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.append(ms)

    def _counted(self, **methods):
        def of(f):
            def call(*x):
                self.calls += 1
                return f(*x)

            return call

        return SimpleNamespace(**{k: of(f) for k, f in methods.items()})

    def getListState(self, *_):  # noqa: N802
        held = []
        return self._counted(appendList=held.extend, get=lambda: iter(list(held)), clear=held.clear, put=lambda x: held.__setitem__(slice(None), x))

    def getMapState(self, *_):  # noqa: N802
        held = {}
        return self._counted(updateValue=held.__setitem__, removeKey=lambda k: held.pop(k, None), containsKey=held.__contains__, getValue=held.__getitem__, keys=lambda: iter(list(held)), iterator=lambda: iter(list(held.items())), clear=held.clear)

    def getValueState(self, *_):  # noqa: N802
        held = {}
        return self._counted(exists=lambda: 0 in held, get=lambda: held[0], update=lambda x: held.__setitem__(0, x), clear=held.clear)


def test_calls_to_the_state_grow_with_documents_and_not_with_events():
    handle, jobs, out = Handle(), progress._Jobs(3_600_000), []
    jobs.init(handle)
    events = [{"ms": 1000 * i, "id": i, "doc": i % 3, "progress": i / 600, "docs": 3, "prior": None} for i in range(600)]
    for k in (0, 300):
        mark = 1000 * (k + 200)
        assert list(jobs.handleInputRows((1,), iter(events[k : k + 300]), None)) == []
        for ms in sorted(t for t in handle.timers if t <= mark):
            handle.timers.remove(ms)
            out += jobs.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m), SimpleNamespace(getExpiryTimeInMs=lambda t=ms: t))
    assert [r["ms"] for r in out] == [1000 * i for i in range(501)]
    assert handle.calls < 60
    for ms in sorted(handle.timers):
        out += jobs.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10_000_000), SimpleNamespace(getExpiryTimeInMs=lambda t=ms: t))
    assert [r["kind"] for r in out] == ["progress"] * 600 + ["closed"] and handle.calls < 100
