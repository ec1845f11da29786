"""Centreline windows against a brute-force version on a small mask."""

from terracol.operators import raster as R


def test_windows_sample_the_image_and_stay_inside(spark):
    h, w, length, step, half = 12, 10, 4, 2, 1
    lines = [[(0, c) for c in range(0, 8)], [(r, 4) for r in range(3, 12)], [(r, 9) for r in range(2, 10)]]
    want = set()
    for n, line in enumerate(lines, 1):
        number = {1: 1, 2: 3, 3: 2}[n]  # components are numbered by their first cell
        for start in range(0, len(line) - length, step):
            part = line[start : start + length]
            dr, dc = part[1][0] - part[0][0], part[1][1] - part[0][1]
            seen = [(i, k, r - k * dc, c + k * dr) for i, (r, c) in enumerate(part) for k in range(-half, half + 1)]
            if all(0 <= r < h and 0 <= c < w for _, _, r, c in seen):
                want |= {(number, start // step, i, k, r, c, *part[length // 2], float(r * w + c)) for i, k, r, c in seen}
    cells = spark.createDataFrame([x for line in lines for x in line], "row int, col int")
    pixels = spark.createDataFrame([(r, c, float(r * w + c)) for r in range(h) for c in range(w)], "row int, col int, value double")
    got = R.centerline_windows(cells, pixels, length, 0.5, 3, h, w).select("component", "window", "i", "k", "row", "col", "center_row", "center_col", "value").collect()
    assert want and {tuple(r) for r in got} == want and len(got) == len(want)
