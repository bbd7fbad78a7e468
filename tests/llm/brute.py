"""Plain versions of the operators, for small tables."""

import re, hashlib
A=str.maketrans('ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')
def op4(docs,bench):
    W=re.compile(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
    win={}
    for i,x in bench:
        w=W.findall((x or '').translate(A))
        for k in range(max(1,len(w)-9)):
            if w: win.setdefault(tuple(w[k:k+10]),set()).add(str(i))
    sizes={len(k) for k in win}
    out={}
    for d,x in docs:
        w=W.findall((x or '').translate(A)); hit=set(); items=set()
        for n in sizes:
            for k in range(len(w)-n+1):
                t=tuple(w[k:k+n])
                if t in win: hit.update(range(k,k+n)); items|=win[t]
        out[d]=(len(w),len(hit),len(items),hashlib.sha256(','.join(sorted(items)).encode()).hexdigest(),bool(hit))
    return out
def luhn(s):
    t=0
    for i,c in enumerate(reversed(s)):
        v=int(c)
        if i%2: v=v*2-9 if v>4 else v*2
        t+=v
    return t%10==0
def op7(docs):
    P={'email':r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+','ip':r'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)','card':r'[0-9]([\x20-]?[0-9])+','phone':r'\+[0-9][\x20().0-9-]+[0-9]'}
    out={}
    for d,x in docs:
        x=x or ''; sp=[];n=[]
        for k,p in P.items():
            c=0
            for m in re.finditer(p,x):
                v=m[0]; g=re.sub('[^0-9]','',v)
                ok={'email':True,'ip':k=='ip' and all(int(q)<=255 for q in v.split('.')),'card':13<=len(g)<=19 and luhn(g),'phone':9<=len(g)<=15}[k]
                if ok: sp.append(f'{k}:{m.start()}:{m.end()}'); c+=1
            n.append(c)
        out[d]=(*n,hashlib.sha256(','.join(sp).encode()).hexdigest())
    return out
def op1(docs):
    first={}; W=lambda x:[b.decode() for b in (x or '').encode().split()]
    for d,x in docs:
        w=W(x)
        for i in range(len(w)-12):
            t=tuple(w[i:i+13]); first[t]=min(first.get(t,d),d)
    out={}
    for d,x in docs:
        w=W(x); rm=set()
        for i in range(len(w)-12):
            if first[tuple(w[i:i+13])]<d: rm.update(range(i,i+13))
        out[d]=(len(w),len(rm),hashlib.sha256(' '.join(v for i,v in enumerate(w) if i not in rm).encode()).hexdigest())
    return out
def op3(docs,n=100):
    first={}
    enc=sorted((d,(x or '').encode()) for d,x in docs)
    out={}
    for d,b in enc:
        rm=bytearray(len(b)); 
        for i in range(len(b)-n+1):
            k=hashlib.blake2b(b[i:i+n],digest_size=12).digest()
            if k in first: rm[i:i+n]=b'\1'*n
            else: first[k]=1
        spans=sum(1 for i in range(len(b)) if rm[i] and (i==0 or not rm[i-1]))
        out[d]=(len(b),sum(rm),spans,hashlib.sha256(bytes(c for c,r in zip(b,rm) if not r)).hexdigest())
    return out
def op5(docs,n=4,num=85,den=100):
    sets={}
    for d,x in docs:
        w=[b.decode() for b in (x or '').translate(A).encode().split()]
        sets[d]=frozenset(tuple(w[i:i+n]) for i in range(len(w)-n+1)) if len(w)>=n else frozenset([tuple(w)] if w else [])
    inv={}
    for d,s in sets.items():
        for t in s: inv.setdefault(t,[]).append(d)
    par={d:d for d in sets}
    def find(a):
        while par[a]!=a: par[a]=par[par[a]]; a=par[a]
        return a
    import collections
    for d,s in sets.items():
        c=collections.Counter(e for t in s for e in inv[t] if e<d)
        for e,k in c.items():
            if den*k>=num*(len(s)+len(sets[e])-k):
                a,b=find(d),find(e)
                if a!=b: par[max(a,b)]=min(a,b)
    return {d:(len(s),find(d)) for d,s in sets.items()}
