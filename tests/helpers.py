import csv
import os
import tempfile


def write_csv(header, rows, name="data.csv"):
    """Write a small CSV file and return its path."""
    d = tempfile.mkdtemp(prefix="caisse-csv-")
    path = os.path.join(d, name)
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(header)
        for r in rows:
            w.writerow(r)
    return path
