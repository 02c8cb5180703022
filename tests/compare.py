"""Compare two results as bags of rows, columns sorted by name."""


def _key(row):
    return tuple((value is not None, str(value)) for value in row)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(row[i] for i in order) for row in rows), key=_key)


def spark_bag(frame):
    return bag(frame.columns, [tuple(row) for row in frame.collect()])


def duck_bag(connection, sql):
    cursor = connection.execute(sql)
    return bag([d[0] for d in cursor.description], cursor.fetchall())
