"""Stop words of the annotator. Results depend on them; other lists can be given as parameters."""

CORE_STOP_WORDS = """
a about above after again against ain all am an and any are aren aren't as at be because been before being below between both but by can couldn
couldn't d did didn didn't do does doesn doesn't doing don don't down during each few for from further had hadn hadn't has hasn hasn't have haven
haven't having he he'd he'll he's her here hers herself him himself his how i i'd i'll i'm i've if in into is isn isn't it it'd it'll it's its itself
just ll m ma me mightn mightn't more most mustn mustn't my myself needn needn't no nor not now o of off on once only or other our ours ourselves out
over own re s same shan shan't she she'd she'll she's should should've shouldn shouldn't so some such t than that that'll the their theirs them
themselves then there these they they'd they'll they're they've this those through to too under until up ve very was wasn wasn't we we'd we'll we're
we've were weren weren't what when where which while who whom why will with won won't wouldn wouldn't y you you'd you'll you're you've your yours
yourself yourselves
""".split()

#: Words that are no entity of their own. Entries with capitals or several words never equal a normalised token.
ENTITY_STOP_WORDS = """
-I, -II, -III, 14, A-C, ANOVA, Bar, Bark, Bars, Cell, Cells, Control, Ctrl, DNA, Fig, KDKO, Left, Methods, NS, RNA, Right, Rod, SD, SDS-PAGE, SEM,
Scott, Student, Table, Task, XREF_BIBR, XREF_FIG, [, ], acid, age, alpha, andD, animals, ankle, ankles, antibodies, antibody, antigen, area,
arrowheads, bar, bark, bars, basal, bean, beta, bi, binding, biological replicates, bite, blot, cell, cells, clones, condition, control, crash,
cryptic, culture, cultures, damage, danger, docking, duet, duration, et, experiment, face, fact, fast, fate, feet, fig, figure, finger, fingers, fist,
fluorescence, foot, form, gain, gene, genes, genotype, goat, group, growth, hand, hands, head, hip, hips, hr, image, immunoblotting, impact,
individual, inhibitor, injury, intensity, ir, knee, knees, lead, left, leg, legs, light, link, links, localization, mM, mark, matrix, media, membrane,
microscopy, mitochondrial, nM, neck, net, neurons, nm, one, partial, patients, per, phosphorylation, plasmid, plasmids, post, prey, probe, processes,
protein, protein levels, proteins, red, result, right, rod, role, sensor, set, shoulder, shoulders, size, spatial, starvation, strain, task, time,
tissue, toe, toes, top, transfection, treatment, tube, type, vs, water, white, wt, µM, µm, family, families, role, roles, review, reviews, goal, goals
"""
ENTITY_STOP_WORDS = [w.strip() for w in ENTITY_STOP_WORDS.replace("\n", " ").split(", ")]
