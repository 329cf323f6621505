"""Search, clustering, quantisation, graph, label, maintenance and evaluation operators."""
