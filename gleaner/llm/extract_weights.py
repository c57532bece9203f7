"""Weights of the page model: train(pages_labelled()) of extract.py, to six digits. A test trains them again."""

MODEL = {
    "edge": [[0.84012, -2.815777], [-0.369647, 1.55712]],
    "w": {
        "bad": -3.342011, "good": 3.194109, "hidden": -3.93289, "leaf": 0.019036, "link:0": 2.075844, "link:1": 0.455877,
        "link:2": -2.105864, "n:0": -0.356758, "n:1": -0.051863, "n:2": 0.627347, "n:3": 0.897002, "n:4": 0.879839,
        "n:5": 2.390406, "t:article": 1.671722, "t:aside": -3.341211, "t:blockquote": 1.535528, "t:body": 3.489974, "t:dialog": -4.095429,
        "t:div": -1.358438, "t:figcaption": 1.603488, "t:figure": 1.149906, "t:footer": -4.822342, "t:form": -4.801567, "t:h1": 1.11887,
        "t:h2": -0.918016, "t:h3": -1.955806, "t:h4": 1.45345, "t:header": -4.406586, "t:html": 1.832959, "t:li": -0.683236,
        "t:main": 1.683515, "t:nav": -3.364501, "t:ol": 1.282776, "t:p": -1.083009, "t:pre": 1.391623, "t:root": 1.758462,
        "t:section": -2.109363, "t:table": 1.003516, "t:td": 1.70714, "t:th": 1.814837, "t:tr": 0.928198, "t:ul": -1.942003,
    },
}
