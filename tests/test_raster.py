import numpy as np

from samplewright.operators import raster

RNG = np.random.default_rng(3)


def scene(n=2, h=48, w=64):
    images = 0.4 + 0.1 * np.linspace(0, 1, w)[None, None] + RNG.normal(0, 0.01, (n, h, w))
    masks = np.zeros((n, h, w), bool)
    masks[:, 12:32, 16:40] = True
    return np.where(masks, 0.8, images), masks


def flood(mask):
    left, sizes = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        stack, size = [left.pop()], 0
        while stack:
            y, x = stack.pop()
            size += 1
            for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if p in left:
                    left.remove(p)
                    stack.append(p)
        sizes.append(size)
    return sorted(sizes, reverse=True)


def test_components_against_flood_fill():
    for _ in range(5):
        mask = RNG.random((17, 23)) < 0.55
        assert raster.components(mask).tolist() == flood(mask)
    assert raster.components(np.zeros((3, 3), bool)).tolist() == []


def test_morphology_against_definition():
    mask = RNG.random((1, 12, 15)) < 0.3
    near = np.zeros_like(mask)
    ys, xs = np.indices(mask.shape[1:])
    for y, x in np.argwhere(mask[0]):
        near[0] |= abs(ys - y) + abs(xs - x) <= 2
    assert (raster.dilate(mask, 2) == near).all()
    assert (raster.erode(mask, 1) == ~raster.dilate(~mask, 1)).all()
    assert raster.erode(np.ones((1, 5, 5), bool), 2).all()  # the border does not erode


def test_window_mean_against_loops():
    x = RNG.random((1, 9, 7))
    padded = np.pad(x, ((0, 0), (4, 4), (4, 4)), mode="edge")
    want = np.array([[padded[0, i : i + 8, j : j + 8].mean() for j in range(7)] for i in range(9)])
    assert np.allclose(raster.window_mean(x, 8)[0], want)


def test_identical_images_score_best_and_damage_lowers_it():
    images, masks = scene()
    same = raster.background(images, images, masks)
    assert np.allclose(same["ssim"], 1) and not same["changed_ratio"].any() and (same["perceptual_delta"] == 1).all()
    spoiled = images.copy()
    spoiled[:, :8] += 0.4
    worse = raster.background(images, spoiled, masks)
    assert (worse["changed_ratio"] > 0.1).all() and (worse["ssim"] < 1).all()
    everything = raster.background(images, spoiled, np.ones_like(masks))
    assert (everything["ssim"] == 1).all() and (everything["perceptual_delta"] == 1).all()


def test_movement_and_empty_masks():
    _, masks = scene(1)
    moved = np.roll(masks, 4, -1)
    m = raster.movement(masks, moved)
    assert np.isclose(m["centroid_shift"][0], 4 / np.hypot(48, 64)) and m["area_ratio"][0] == 1 and m["aspect_delta"][0] == 0
    e = raster.movement(masks, np.zeros_like(masks))
    assert [float(e[k][0]) for k in ("centroid_shift", "area_ratio", "aspect_delta", "contact_shift")] == [1, 0, 1, 1]
    b = raster.boundary(scene(1)[0], np.zeros_like(masks))
    assert b["seam"][0] == 0 and b["gradient_gap"][0] == 1 and np.isnan(b["interior_area"][0])


def test_artifacts_see_broken_shapes():
    images, masks = scene(1)
    broken = masks.copy()
    broken[0, 40:44, 50:60] = True
    assert raster.artifacts(images, masks)["component_ratio"][0] == 1 and raster.artifacts(images, broken)["component_ratio"][0] < 1


def test_hashes_are_stable_under_brightness_and_differ_between_images():
    a, b = RNG.random((1, 40, 40)), RNG.random((1, 40, 40))
    ha, hb, hc = (raster.perceptual_hashes(x) for x in (a, a * 0.5 + 0.1, b))
    assert ha["phash"] == hb["phash"] and ha["dhash"] == hb["dhash"] and ha["phash"] != hc["phash"]


def test_measure_handles_several_shapes_in_a_batch(spark):
    rows = [("a", [0.5] * 64 * 12, [0.5] * 64 * 12, 64, 12), ("b", [0.5] * 100, [0.9] * 100, 10, 10)]
    df = spark.createDataFrame(rows, "id string, source array<double>, produced array<double>, width int, height int")
    out = {r["id"]: r for r in raster.measure(df).collect()}
    assert out["a"]["ssim"] == 1.0 and out["b"]["changed_ratio"] == 1.0 and out["a"]["interior_area"] is None


def test_a_change_of_colour_at_equal_brightness_is_seen():
    red, blue = np.zeros((1, 3, 12, 12)), np.zeros((1, 3, 12, 12))
    red[:, 0], blue[:, 2] = 0.8, 0.8
    out = raster.background(red, blue, np.zeros((1, 12, 12), bool))
    assert out["changed_ratio"][0] == 1 and abs(out["mean_delta"][0] - 1.6 / 3) < 1e-12 and out["perceptual_delta"][0] == 0 and out["ssim"][0] == 1
