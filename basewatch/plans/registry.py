"""How the plan modules name their queries."""


def registry():
    """A decorator query(name, sql=None), and the two dicts that it fills."""
    queries, sqls = {}, {}

    def query(name, sql=None):
        def add(f):
            queries[name] = f
            if sql:
                sqls[name] = sql
            return f

        return add

    return query, queries, sqls
